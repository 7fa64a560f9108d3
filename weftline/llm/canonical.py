"""Free-entered values to the entries of a reference list.

Values are read as tokens (damaged encodings repaired, accents and case folded, generic words and brackets dropped). Every distinct token is joined
to the reference vocabulary by edit distance, over deletion neighbourhoods, so the join is an equi-join, and short ones as abbreviations of its frequent words; the repaired tokens are
then combined by soft TF-IDF to rank complete entries. A value is also read as one token, its letters joined, against the
entries' joined letters, for lost and inserted blanks. Codes are looked up as they are.

Defined results:
* null and blank values give no row; every other distinct value gives one, with an empty entry if it fits none;
* an entry fits if all its tokens and all of the value's are matched one to one, within two edits in all (one in short names, none in very short ones).
  The score must also reach 0.8, which is stricter: of one-word entries it refuses 8 or 9 letters with two edits and 4 letters with one;
* ties are broken by score, edits and then the entry's spelling; repeated rows and reference rows count once;
* an alias or code that stands for several entries stands for none; a reference without entries makes every value unmatched;
* values of any length are read whole; tokens longer than any entry by more than two letters can't match and are not expanded.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.session import staged

# Fixed values, the default of a parameter: English words that say what kind of thing is named, not which. Counts can't tell them from words that make
# another name of it ("old", "north"), which are as frequent in typed values and as absent from the entries.
GENERIC = frozenset({"city", "of", "greater", "metro", "metropolitan", "area", "airport", "town", "the"})
LEAST_SCORE = 0.8


def repair(text: str) -> str:
    """UTF-8 that was read as a single-byte encoding, read again."""
    for encoding in ("cp1252", "latin-1"):
        try:
            again = text.encode(encoding).decode("utf-8")
        except (UnicodeEncodeError, UnicodeDecodeError):
            continue
        return again
    return text


def fold(text: str) -> str:
    """Lower case without accents."""
    return "".join(c for c in unicodedata.normalize("NFKD", repair(text)) if not unicodedata.combining(c)).casefold()


def tokens_of(text: str, countries: frozenset[str] = frozenset(), generic: frozenset[str] = GENERIC) -> list[str]:
    folded = fold(text)
    outside = re.sub(r"\([^)]*\)|\[[^]]*\]", " ", folded)
    read = lambda s: re.findall(r"[^\W_]+", s)
    found = read(outside) or read(folded)
    kept = [t for t in found if t not in generic and t not in countries]
    return kept or found


def allowed(n: int) -> int:
    """Edits that a name of ``n`` letters may hold."""
    return 0 if n < 4 else 1 if n < 8 else 2


def edits(a: str, b: str, most: int) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours; ``most`` + 1 if there are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before: list[int] = []
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            v = min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, before[j - 2] + 1)
            new.append(v)
        if min(new) > most:
            return most + 1
        before, row = row, new
    return min(row[-1], most + 1)


def _variants(token: str) -> set[str]:
    k = allowed(len(token) + 1)
    out, last = {token}, {token}
    for _ in range(k):
        last = {s[:i] + s[i + 1 :] for s in last for i in range(len(s))}
        out |= last
    return out


def _neighbourhoods(tokens: DataFrame, longest: int) -> DataFrame:
    """(token, variant) of a ``token`` column, each token cut by the letters it may lack."""
    schema = T.StructType([T.StructField("token", T.StringType()), T.StructField("variant", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for t in batch.column(0).to_pylist():
                if len(t) <= longest:
                    v = _variants(t)
                    a += [t] * len(v)
                    b += v
                if len(a) > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string())], names=schema.names)
                    a, b = [], []
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string())], names=schema.names)

    return tokens.select("token").mapInArrow(run, schema)


def token_repairs(tokens: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(token, word, edits): each distinct ``token`` with the words of the vocabulary (column ``word``) it may be."""
    words = vocabulary.select(F.col("word").alias("token")).distinct()
    longest = words.agg(F.max(F.length("token"))).first()[0] or 0
    left = _neighbourhoods(tokens.select("token").distinct(), longest + 2)
    right = _neighbourhoods(words, longest).withColumnRenamed("token", "word")
    pairs = left.join(right, "variant").select("token", "word").distinct()
    n = F.least(F.length("token"), F.length("word"))
    most = F.when(n < 4, 0).when(n < 8, 1).otherwise(2)
    # a swap is two edits to the JVM's distance: what is within the bound by it needs no second look, what is beyond twice the bound neither
    plain = pairs.select("token", "word", most.alias("most"), F.levenshtein("token", "word", 4).alias("edits")).where((F.col("edits") >= 0) & (F.col("edits") <= 2 * F.col("most")))
    schema = T.StructType([T.StructField("token", T.StringType()), T.StructField("word", T.StringType()), T.StructField("edits", T.IntegerType())])

    def swaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, bound, d = (c.to_pylist() for c in batch.columns)
            got = [x if x <= 1 else edits(p, q, m) for p, q, m, x in zip(a, b, bound, d, strict=True)]
            keep = pa.array([i for i, (x, m) in enumerate(zip(got, bound, strict=True)) if x <= m], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep), pa.array(got, pa.int32()).take(keep)], names=schema.names)

    return plain.mapInArrow(swaps, schema)


def abbreviations(tokens: DataFrame, words: DataFrame) -> DataFrame:
    """(token, word, edits): short tokens made of some letters of a word, in order, with its first and last one. It counts as no edit.

    Only the most frequent word of a name of several words ("Fort", "Saint") is abbreviated, never what tells the names apart. ``words`` has (name, word).
    """
    n = words.groupBy("word").agg(F.count("*").alias("n"))
    over = Window.partitionBy("name")
    ranked = words.join(n, "word").withColumn("most", F.max("n").over(over)).withColumn("k", F.count("*").over(over))
    common = ranked.where((F.col("k") > 1) & (F.col("n") == F.col("most")) & (F.length("word") >= 4)).select("word").distinct().select("word", F.substring("word", 1, 1).alias("first"), F.substring("word", -1, 1).alias("last"))
    short = tokens.where(F.length("token").between(2, 4)).select("token", F.substring("token", 1, 1).alias("first"), F.substring("token", -1, 1).alias("last"), F.concat_ws(".*", F.split("token", "")).alias("pattern"))
    hit = short.join(common, ["first", "last"]).where((F.length("word") > F.length("token")) & F.expr("word RLIKE concat('^', pattern, '$')"))
    return hit.select("token", "word", F.lit(0).alias("edits"))


def _read(values: DataFrame, countries: frozenset[str], generic: frozenset[str]) -> DataFrame:
    """(value, tokens, joined) of every distinct value that isn't blank."""
    schema = T.StructType([T.StructField("value", T.StringType()), T.StructField("tokens", T.ArrayType(T.StringType())), T.StructField("joined", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(0).to_pylist()
            t = [tokens_of(x, countries, generic) for x in v]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(t, pa.list_(pa.string())), pa.array(["".join(x) for x in t], pa.string())], names=schema.names)

    return values.mapInArrow(run, schema)


def map_values(values: DataFrame, value: str, entries: DataFrame, entry: str, codes: DataFrame | None = None, code: str = "code", aliases: DataFrame | None = None, alias: str = "alias", countries: frozenset[str] = frozenset(), generic: frozenset[str] = GENERIC) -> DataFrame:
    """(value, entry, score, edits) of every distinct value; the entry is empty where none fits.

    ``codes`` and ``aliases`` map other spellings (columns ``code``, ``alias``) to ``entry`` of the list. ``countries`` are two-letter codes that may stand behind a name,
    ``generic`` are words that don't count unless a value has no others.
    """
    distinct = values.select(F.col(value).alias("value")).where(F.col("value").rlike(r"\S")).distinct()
    read = staged(_read(distinct, countries, generic), "read")
    names = entries.where(F.col(entry).rlike(r"\S")).select(F.col(entry).alias("value"), F.col(entry).alias("entry"))
    if aliases is not None:
        single = aliases.where(F.col(alias).rlike(r"\S")).groupBy(F.col(alias).alias("value")).agg(F.min(entry).alias("entry"), F.count_distinct(F.coalesce(entry, F.lit(""))).alias("k"))
        names = names.unionByName(single.where((F.col("k") == 1) & F.col("entry").isNotNull()).select("value", "entry"))
    names = names.distinct()
    spelled = _read(names.select("value").distinct(), frozenset(), generic).join(names, "value").select(F.col("value").alias("name"), "entry", F.col("tokens").alias("parts"), F.col("joined").alias("whole"))
    spelled = staged(spelled, "spelled")
    n_names = spelled.count()
    words = spelled.select("name", F.explode(F.array_distinct("parts")).alias("word"))
    idf = words.groupBy("word").agg((F.log(F.lit(float(max(n_names, 1)) + 1) / F.count("*"))).alias("idf"))
    wholes = spelled.select("whole").distinct()
    # tokens and joined values are repaired in one join; the two readings stay apart by their vocabulary
    typed = read.select(F.explode("tokens").alias("token")).union(read.select("joined")).distinct()
    repairs = token_repairs(typed, words.select("word").union(wholes.select("whole"))).unionByName(abbreviations(typed, words))
    fixes = staged(repairs.groupBy("token", "word").agg(F.min("edits").alias("edits")), "fixes")
    weighted = fixes.join(staged(idf, "idf"), "word")
    # reading by tokens: candidates come from the value's weightiest repaired token
    repaired = staged(read.select("value", F.posexplode("tokens").alias("pos", "token")).join(weighted, "token"), "repaired")
    best = Window.partitionBy("value").orderBy(F.desc("weight"), "pos")
    lead = repaired.groupBy("value", "pos").agg(F.max("idf").alias("weight")).withColumn("k", F.row_number().over(best)).where("k = 1").select("value", "pos")
    listed = repaired.groupBy("value").agg(F.collect_set(F.struct("pos", "word", "edits", "idf")).alias("fixes"))
    pairs = repaired.join(lead, ["value", "pos"]).select("value", "word").distinct().join(words, "word").select("value", "name").distinct()
    scored_schema = T.StructType([T.StructField("value", T.StringType()), T.StructField("entry", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("edits", T.IntegerType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                parts, n = r["parts"], r["n"]
                if len(parts) != n:
                    continue
                by: dict[str, list[tuple[int, int, float]]] = {}
                for f in r["fixes"]:
                    by.setdefault(f["word"], []).append((f["edits"], f["pos"], f["idf"]))
                used, total, dot = set(), 0, 0.0
                for w in sorted(parts, key=lambda w: len(by.get(w, ()))):
                    free = sorted(x for x in by.get(w, ()) if x[1] not in used)
                    if not free:
                        break
                    e, pos, weight = free[0]
                    used.add(pos)
                    total += e
                    dot += weight * weight * (1 - e / max(len(w), 1))
                else:
                    norm = sum(by[w][0][2] ** 2 for w in parts) or 1.0
                    if total <= allowed(len("".join(parts))):
                        out.append((r["value"], r["entry"], dot / norm if math.isfinite(dot) else 0.0, total))
            cols = list(zip(*out, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.int32())], names=scored_schema.names)

    by_tokens = pairs.join(listed, "value").join(read.select("value", F.size("tokens").alias("n")), "value").join(spelled.select("name", "entry", "parts"), "name").select("value", "entry", "n", "parts", "fixes").mapInArrow(score, scored_schema)
    # reading as one token
    joined = read.select("value", F.col("joined").alias("token")).join(fixes, "token").join(spelled.select("entry", F.col("whole").alias("word")), "word")
    by_whole = joined.select("value", "entry", (1 - F.col("edits") / F.greatest(F.length("word"), F.lit(1))).alias("score"), "edits")
    options = by_tokens.unionByName(by_whole).withColumn("rank", F.lit(1))
    if codes is not None:
        known = codes.where(F.col(code).rlike(r"\S")).groupBy(F.lower(F.trim(code)).alias("code")).agg(F.min(entry).alias("entry"), F.count_distinct(F.coalesce(entry, F.lit(""))).alias("k")).where("k = 1")
        hit = read.where(F.size("tokens") == 1).select("value", F.regexp_extract(F.col("tokens")[0], r"^([a-z]{3})\d*$", 1).alias("code")).join(known, "code")
        options = options.unionByName(hit.select("value", F.coalesce("entry", F.lit("")).alias("entry"), F.lit(1.0).alias("score"), F.lit(0).alias("edits"), F.lit(0).alias("rank")))
    w = Window.partitionBy("value").orderBy("rank", F.desc("score"), "edits", "entry")
    top = options.where(F.col("score") >= LEAST_SCORE).withColumn("k", F.row_number().over(w)).where("k = 1").select("value", "entry", "score", "edits")
    return read.select("value").join(top, "value", "left").select("value", F.coalesce("entry", F.lit("")).alias("entry"), F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("edits", F.lit(0)).alias("edits"))
