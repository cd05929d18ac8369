"""python -m fellscape simulate|fit|report|query ..."""

from __future__ import annotations

import argparse

from fellscape.session import build_session


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="fellscape")
    sub = p.add_subparsers(dest="what", required=True)
    s = sub.add_parser("simulate", help="write synthetic cells as Parquet")
    s.add_argument("out")
    s.add_argument("--cells", type=int, default=400)
    s.add_argument("--genes", type=int, default=8)
    s = sub.add_parser("fit", help="fit a landscape to Parquet cells (idx, label, expr, vel) and write its tables")
    s.add_argument("cells")
    s.add_argument("out")
    s.add_argument("--source", required=True)
    s.add_argument("--target", required=True)
    s.add_argument("--neighbors", type=int, default=10)
    s.add_argument("--dimensions", type=int, default=6)
    s = sub.add_parser("report", help="show the report of a fit")
    s.add_argument("fit")
    s = sub.add_parser("query", help="run a registered query over a folder of tables")
    s.add_argument("name")
    s.add_argument("folder")
    a = p.parse_args(argv)
    spark = build_session()
    if a.what == "simulate":
        from fellscape.api import simulate

        simulate(spark, a.cells, a.genes).write.mode("overwrite").parquet(a.out)
    elif a.what == "fit":
        from fellscape.api import Config, analyze, exported, reduce_cells
        from fellscape.sources.files import export_cells, save_tables

        cells, config = spark.read.parquet(a.cells), Config(neighbors=a.neighbors, dimensions=a.dimensions)
        genes = len(cells.select("expr").first()[0])
        fit = analyze(reduce_cells(cells, genes, config), a.source, a.target, config)
        save_tables({"nodes": fit.nodes, "edges": fit.edges, "attractors": fit.attractors, "report": fit.report}, a.out)
        export_cells(exported(fit), f"{a.out}/cells_csv")
    elif a.what == "report":
        spark.read.parquet(f"{a.fit}/report").show(truncate=False, vertical=True)
    else:
        import importlib

        importlib.import_module("__spark_entry__").queries()[a.name](spark, a.folder).show(50, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
