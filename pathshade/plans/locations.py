"""Where a run's files go. In the smart mode inputs and bundles live below
``data/datasets/KEY`` and runs below ``data/experiments/KEY``; in the legacy mode all
paths stay as they are given."""

from __future__ import annotations

from pyspark.sql import SparkSession

from pathshade.functions.text import dataset_key, sanitized

# Fixed names of files in a data set's folder, by option; the first is written, the rest are read.
WRITTEN = {"emit_edges": "edges.txt"}
READ = {"edges": "edges.txt", "pack_candidates": "cands.txt", "pack_blocked": "blocked.txt"}


def located(options: dict, exists=lambda path: False) -> tuple[dict, list[tuple[str, str]], list[str]]:
    """(options, copies, log) of a run: its options with rewritten paths, the (source,
    target) files to copy first, and what the log says of it."""
    out, copies = dict(options), []
    if options.get("paths_mode") != "smart":
        out["dataset_key"] = sanitized(options["dataset_key"]) if options.get("dataset_key") else dataset_key(options)[0]
        return out, [], []
    key, rule = dataset_key(options)
    root, runs = f"data/datasets/{key}", f"data/experiments/{key}"
    out["dataset_key"], log = key, [f"[info] dataset_key={key} (inferred from {rule})"]
    for name, file in {**WRITTEN, **READ}.items():
        given, target = options.get(name), f"{root}/{file}"
        if not given or given == target or (name in READ and not exists(given)):
            continue  # a missing input keeps its path, for the error to name it
        if name in READ:
            copies.append((given, target))
        out[name] = target
        log.append(f"[info] {name} path rewritten to {target}")
    if options.get("graph_bin_out"):
        out["graph_bin_out"] = f"{root}/{key}.bin"
    if options.get("graph_bin_in") and exists(f"{root}/{key}.bin"):
        out["graph_bin_in"] = f"{root}/{key}.bin"
    if options.get("out_dir") in ("data", root, f"data/{key}"):
        out["out_dir"] = runs
    log += [f"[info] {name} path rewritten to {out[name]}" for name in ("graph_bin_out", "graph_bin_in", "out_dir") if out.get(name) != options.get(name)]
    return out, copies, [*log, f"[info] dataset_root={root}"]


def on_disk(spark: SparkSession):
    """A test whether a path exists on the file system it names."""

    def exists(path: str) -> bool:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)

    return exists


def copy(spark: SparkSession, source: str, target: str) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    a, b = (jvm.org.apache.hadoop.fs.Path(x) for x in (source, target))
    jvm.org.apache.hadoop.fs.FileUtil.copy(a.getFileSystem(conf), a, b.getFileSystem(conf), b, False, True, conf)
