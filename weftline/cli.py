"""python -m weftline: run a query, list them, explain their plans, or build the map's bundle from a folder of tables."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from weftline.session import build_session


def _modules() -> list:
    from weftline.plans import graphs, problems, relational, remaining, scalar, streams, worlds

    return [problems, scalar, relational, graphs, streams, worlds, remaining]


def _queries() -> dict:
    return {k: f for m in _modules() for k, f in m.QUERIES.items()}


def run(args) -> None:
    df = _queries()[args.query](build_session(master=args.master), args.tables)
    if args.out:
        df.write.mode("overwrite").parquet(args.out)
    else:
        df.show(args.rows, truncate=False)


def explain(args) -> None:
    _queries()[args.query](build_session(master=args.master), args.tables).explain("formatted")


def listed(args) -> None:
    for name, f in sorted(_queries().items()):
        print(f"{name:24} {(f.__doc__ or '').strip().splitlines()[0] if f.__doc__ else ''}")


def build(args) -> None:
    """Profiles, hierarchy, backbone, sampling ranks and map layout of the networks, written as one bundle."""
    from weftline.operators import graph, profiles
    from weftline.plans import fixtures as fx
    from weftline.sources.sinks import write_bundle

    spark = build_session(master=args.master)
    edges = fx.edges(spark, args.tables)
    cones, core = graph.customer_cones(edges), graph.coreness(edges)
    level = graph.levels(cones, core)
    back = graph.backbone(edges, cones, level).withColumn("backbone", F.lit(True))
    nodes = graph.degrees(edges).join(cones, "node").join(core, "node").join(level, "node")
    placed = profiles.fan_out(fx.node_positions(spark, args.tables).join(nodes.select("node", "degree"), "node"), "node", "degree")
    nodes = nodes.join(placed, "node", "left")
    edges = edges.join(back, "eid", "left").fillna(False, ["backbone"])
    print(write_bundle(args.out, nodes, edges, args.name, nodes.select("node", F.to_json(F.struct("degree", "cone", "core")).alias("record"))))


def tiles(args) -> None:
    from weftline.operators import raster
    from weftline.plans.relational import _merc_links

    spark = build_session(master=args.master)
    links = _merc_links(spark, args.tables).withColumn("r", F.lit(0.9)).withColumn("g", F.lit(0.6)).withColumn("b", F.lit(0.3))
    raster.write_tiles(raster.render_tiles(links, list(range(args.zoom + 1))), args.out)


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="weftline", description=__doc__)
    p.add_argument("--master", help="Spark master, if the environment doesn't give one")
    sub = p.add_subparsers(required=True)

    def command(name, f, *more):
        c = sub.add_parser(name, help=(f.__doc__ or name))
        for flags, kw in more:
            c.add_argument(*flags, **kw)
        c.set_defaults(f=f)

    tables = (("--tables",), {"required": True, "help": "folder of the Parquet tables"})
    command("list", listed)
    command("run", run, (("query",), {"choices": sorted(_queries()), "metavar": "query"}), tables, (("--out",), {}), (("--rows",), {"type": int, "default": 20}))
    command("explain", explain, (("query",), {"choices": sorted(_queries()), "metavar": "query"}), tables)
    command("build", build, tables, (("--out",), {"required": True}), (("--name",), {"default": "map"}))
    command("tiles", tiles, tables, (("--out",), {"required": True}), (("--zoom",), {"type": int, "default": 3}))
    args = p.parse_args(argv)
    args.f(args)


if __name__ == "__main__":
    main()
