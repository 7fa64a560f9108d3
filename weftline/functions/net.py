"""Addresses and prefixes. IPv4 is arithmetic on longs; IPv6 is 16 bytes, which compare as they should."""

from __future__ import annotations

import ipaddress
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.geo import col

# Blocks that are never routed publicly.
BOGONS = (("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.0.0", 24), ("192.168.0.0", 16), ("198.18.0.0", 15), ("224.0.0.0", 3))
SHARED, PRIVATE = (("100.64.0.0", 10),), (("10.0.0.0", 8), ("172.16.0.0", 12), ("192.168.0.0", 16), ("169.254.0.0", 16), ("127.0.0.0", 8))


def ipv4_number(text) -> Column:
    """Number of a dotted quad; null if it is none."""
    parts = F.split(col(text), r"\.")
    ok = col(text).rlike(r"^\d{1,3}(\.\d{1,3}){3}$") & F.forall(parts, lambda p: p.cast("int") <= 255)
    return F.when(ok, F.aggregate(parts, F.lit(0).cast("long"), lambda acc, p: acc * 256 + p.cast("long")))


def ipv4_text(number) -> Column:
    n = col(number)
    return F.concat_ws(".", *[F.pmod(F.shiftright(n, s), F.lit(256)).cast("string") for s in (24, 16, 8, 0)])


def _range(base: str, bits: int) -> tuple[int, int]:
    net = ipaddress.ip_network(f"{base}/{bits}")
    return int(net[0]), int(net[-1])


def in_blocks(number, blocks) -> Column:
    n, hit = col(number), F.lit(False)
    for b in blocks:
        lo, hi = _range(*b)
        hit = hit | n.between(lo, hi)
    return hit


def is_bogon(number) -> Column:
    return in_blocks(number, BOGONS)


def address_kind(number) -> Column:
    """'shared' (carrier translation), 'private' or 'public'."""
    return F.when(in_blocks(number, SHARED), "shared").when(in_blocks(number, PRIVATE), "private").otherwise("public")


def cidr4(text) -> Column:
    """struct<lo, hi, plen> of an IPv4 prefix with its host bits cleared; null if it is none."""
    n = ipv4_number(F.split(F.trim(col(text)), "/")[0])
    plen = F.get(F.split(F.trim(col(text)), "/"), F.lit(1)).try_cast("int")
    size = F.pow(F.lit(2.0), 32 - plen).cast("long")
    lo = n - F.pmod(n, size)
    return F.when(n.isNotNull() & plen.between(0, 32), F.struct(lo.alias("lo"), (lo + size - 1).alias("hi"), plen.alias("plen")))


@F.pandas_udf(T.BinaryType())
def address_bytes(texts: pd.Series) -> pd.Series:
    """16 bytes of an IPv4 (mapped) or IPv6 address; null if it is none."""

    def one(t):
        try:
            a = ipaddress.ip_address(t.strip())
        except (ValueError, AttributeError):
            return None
        return (b"\0" * 10 + b"\xff\xff" + a.packed) if a.version == 4 else a.packed

    return texts.map(one)


_CIDR = T.StructType([T.StructField("version", T.IntegerType()), T.StructField("lo", T.BinaryType()), T.StructField("hi", T.BinaryType()), T.StructField("plen", T.IntegerType()), T.StructField("text", T.StringType())])


@F.pandas_udf(_CIDR)
def cidr(texts: pd.Series) -> pd.DataFrame:
    """struct<version, lo, hi, plen, text> of a prefix of either family in canonical form; nulls if it is none."""
    rows = []
    for t in texts:
        try:
            n = ipaddress.ip_network(t.strip(), strict=False)
            pad = b"\0" * 10 + b"\xff\xff" if n.version == 4 else b""
            rows.append((n.version, pad + n[0].packed, pad + n[-1].packed, n.prefixlen, str(n)))
        except (ValueError, AttributeError):
            rows.append((None, None, None, None, None))
    return pd.DataFrame(rows, columns=["version", "lo", "hi", "plen", "text"]).astype({"version": "Int32", "plen": "Int32"})


@F.pandas_udf(T.BinaryType())
def first_bits(addresses: pd.Series, bits: pd.Series) -> pd.Series:
    """Addresses of 16 bytes cut to their first bits; an IPv4 prefix's length counts 96 more."""
    cut = lambda a, k: None if a is None or pd.isna(k) else (int.from_bytes(a, "big") >> (128 - int(k)) << (128 - int(k))).to_bytes(16, "big")
    return pd.Series([cut(a, k) for a, k in zip(addresses, bits, strict=True)], dtype=object)


def contains(lo, hi, address) -> Column:
    return col(address).between(col(lo), col(hi))


def range_cidrs(lo: int, hi: int) -> Iterator[tuple[int, int]]:
    """The least prefixes that cover the whole numbers lo..hi of IPv4: (first address, length)."""
    while lo <= hi:
        align = (lo & -lo).bit_length() - 1 if lo else 32
        bits = min(align, (hi - lo + 1).bit_length() - 1)
        yield lo, 32 - bits
        lo += 1 << bits


@F.udtf(returnType="network: bigint, plen: int")
class RangeCidrs:
    """Table function: the prefixes of an inclusive range."""

    def eval(self, lo: int, hi: int):
        if lo is not None and hi is not None:
            yield from range_cidrs(lo, hi)
