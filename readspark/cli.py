"""Command line: models from FASTQ, fewer contexts, compression and statistics.

    python -m readspark.cli stats reads.fastq
    python -m readspark.cli generate-model acids generic_ao2_qo0_pb0 reads.fastq -o models
    python -m readspark.cli compress reads.fastq -o reads.rspk --models models

A directory of models is a Parquet table with a partition for each model. ``-`` as an
input is the standard input, which is put in the shared folder first.
"""

from __future__ import annotations

import argparse
import csv
import sys
from collections.abc import Callable
from pathlib import Path

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.alphabet import SIZES
from .functions.keys import KEY_TYPES, spec_of
from .operators import binning, blocks, models, stats
from .session import ship
from .sources import container
from .sources.fastq import fastq_text, read_fastq
from .storage import new_path

MODES = {"acids": "acids", "q-scores": "q_scores"}


def _given(spark: SparkSession, path: str) -> str:
    """A path that executors can read."""
    if path != "-":
        return path
    uri = new_path(spark, "stdin")
    fs, at = pafs.FileSystem.from_uri(uri)
    with fs.open_output_stream(at, compression=None) as sink:
        while chunk := sys.stdin.buffer.read(1 << 20):
            sink.write(chunk)
    return uri


def _reads(spark: SparkSession, path: str) -> DataFrame:
    return read_fastq(spark, _given(spark, path))


def _table(rows: list[tuple], head: tuple[str, ...]) -> None:
    out = csv.writer(sys.stdout, lineterminator="\n")
    out.writerows([head, *rows])


def stats_verb(spark: SparkSession, a: argparse.Namespace) -> None:
    reads = _reads(spark, a.input)
    for kind in MODES.values():
        print("\n".join(stats.report(stats.symbol_stats(reads, kind))), file=sys.stderr)


def generate_model(spark: SparkSession, a: argparse.Namespace) -> None:
    reads, kind = _reads(spark, a.input), MODES[a.mode]
    row = models.rates(models.all_counts(reads, [spec_of(a.context)], (kind,)), a.limit).first()
    if row is not None and row["too_big"]:
        print(f"Too big: {a.limit} contexts or more", file=sys.stderr)
        return
    found = models.build(reads, a.context, kind)
    name = models.save(found, a.output or str(Path(a.input).with_suffix(".models")), kind, a.context)
    print(f"{name.hex()[:8]}: {row['n_contexts'] if row else 0} contexts, {row['rate'] if row else 0:.4f}bpv", file=sys.stderr)


def generate_model_all(spark: SparkSession, a: argparse.Namespace) -> None:
    reads = _reads(spark, a.input)
    found = models.rates(models.all_counts(reads, list(KEY_TYPES.values())), a.limit).orderBy("model_type", "spec_type").collect()
    for row in found:
        if not row["too_big"]:
            models.save(models.build(reads, row["spec_type"], row["model_type"]), f"{a.output}/{a.name}", row["model_type"], row["spec_type"])
    if a.csv:
        _table([(r["model_type"], r["spec_type"], r["rate"], r["n_contexts"]) for r in found], ("model type", "spec type", "rate", "context num"))


def _tree(spark: SparkSession, a: argparse.Namespace) -> tuple[binning.Tree, str, str]:
    """The merge tree of the one model of a directory, or of that named ``--model``."""
    table = models.load(spark, a.input)
    names = [r[0] for r in table.select("model_id").distinct().collect() if r[0].startswith(a.model or "")]
    if len(names) != 1:
        raise SystemExit(f"{len(names)} models match; name one with --model")
    own = models.verify(table, names[0])
    row = own.select("model_type", "spec_type").first()
    return binning.tree_of(own.select("specs", "context_prob", "symbol_prob"), a.pre_bin), row["model_type"], row["spec_type"]


def bin_contexts(spark: SparkSession, a: argparse.Namespace) -> None:
    tree, kind, spec = _tree(spark, a)
    name = models.save(binning.binned(spark, tree, a.contexts, a.order), a.output or f"{a.input}.binned", kind, spec)
    print(f"{name.hex()[:8]}: {tree.rate(tree.cut(a.contexts, a.order)):.4f}bpv", file=sys.stderr)


def bin_contexts_all(spark: SparkSession, a: argparse.Namespace) -> None:
    tree, kind, spec = _tree(spark, a)
    rows = []
    for k in binning.steps(tree.leaves, a.num):
        file = f"{a.name}_{k}"
        models.save(binning.binned(spark, tree, k, a.order), f"{a.output}/{file}", kind, spec)
        rows.append((file, k, tree.rate(tree.cut(k, a.order))))
    if a.csv:
        _table(rows, ("filename", "context number", "rate"))


def compress(spark: SparkSession, a: argparse.Namespace) -> None:
    coders, found = container.coders_from(spark, a.models)
    table, used = container.compress_with(_reads(spark, a.input), coders, found, a.block_length or blocks.MAX_BLOCK, a.quality, a.fast, not a.no_identifiers)
    path = new_path(spark, "blocks")
    table.write.parquet(path)
    table = spark.read.parquet(path)
    container.export_file(table, used, a.output or str(Path(a.input).with_suffix(".rspk")))
    row = blocks.compression_stats(table).first()
    print(f"{blocks.format_bytes(row['in_bytes'] or 0)} to {blocks.format_bytes(row['out_bytes'] or 0)} in {row['n_blocks']} blocks, {row['ratio'] or 0}%", file=sys.stderr)


def decompress(spark: SparkSession, a: argparse.Namespace) -> None:
    coders, _ = container.coders_from(spark, a.models)
    found = container.read_file(spark, _given(spark, a.input), coders)
    # Blocks are numbered in order, and hold fewer reads than 2**32.
    text = fastq_text(found.withColumn("read_id", F.shiftleft("block_index", 32) + F.col("place"))).orderBy("read_id").select("value")
    if a.output == "-":
        for row in text.toLocalIterator():
            print(row["value"])
    else:
        text.write.option("lineSep", "\n").text(a.output or str(Path(a.input).with_suffix(".fastq")))


def rechunk(spark: SparkSession, a: argparse.Namespace) -> None:
    reads = _reads(spark, a.input)
    chunks = blocks.joined_chunks(reads, blocks.rechunk(reads, a.seq_length))
    if a.size:
        units = {"k": 10**3, "M": 10**6, "G": 10**9}
        size = int(a.size[:-1]) * units[a.size[-1]] if a.size[-1] in units else int(a.size)
        chunks = blocks.pieces(chunks, size).where(F.col("piece") == a.chunk)
    named = chunks.select(F.col("chunk").alias("read_id"), F.lit("").alias("identifier"), "acids", "quals")
    fastq_text(named).orderBy("read_id").select("value").write.option("lineSep", "\n").text(a.output)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="readspark")
    verbs = top.add_subparsers(required=True)

    def verb(name: str, f: Callable[[SparkSession, argparse.Namespace], None]) -> argparse.ArgumentParser:
        p = verbs.add_parser(name)
        p.set_defaults(run=f)
        return p

    positive = lambda x: int(x) if int(x) > 0 else parser().error("must be 1 or more")
    p = verb("stats", stats_verb)
    p.add_argument("input", nargs="?", default="-")
    p = verb("generate-model", generate_model)
    p.add_argument("mode", choices=list(MODES))
    p.add_argument("context", choices=list(KEY_TYPES))
    p.add_argument("input", nargs="?", default="-")
    p.add_argument("-o", "--output")
    p.add_argument("--limit", type=positive, default=10_000_000)
    p = verb("generate-model-all", generate_model_all)
    for x in ("input", "output", "name"):
        p.add_argument(x)
    p.add_argument("--csv", action="store_true")
    p.add_argument("--limit", type=positive, default=500_000)
    for name, f in (("bin-contexts", bin_contexts), ("bin-contexts-all", bin_contexts_all)):
        p = verb(name, f)
        p.add_argument("input")
        if f is bin_contexts:
            p.add_argument("-o", "--output")
            p.add_argument("-c", "--contexts", type=positive, required=True)
        else:
            p.add_argument("output")
            p.add_argument("name")
            p.add_argument("-n", "--num", type=positive)
            p.add_argument("--csv", action="store_true")
        p.add_argument("--pre-bin", type=positive)
        p.add_argument("--order", choices=["min_cost", "max_cost"], default="min_cost")
        p.add_argument("--model", help="first digits of the identifier")
    p = verb("compress", compress)
    p.add_argument("input", nargs="?", default="-")
    p.add_argument("-o", "--output")
    p.add_argument("--models", default="models")
    p.add_argument("--block-length", type=positive)
    p.add_argument("--no-identifiers", action="store_true")
    p.add_argument("--quality", type=int, choices=range(1, 10), default=7)
    p.add_argument("--fast", action="store_true")
    p = verb("decompress", decompress)
    p.add_argument("input", nargs="?", default="-")
    p.add_argument("-o", "--output")
    p.add_argument("--models", default="models")
    p = verb("rechunk", rechunk)
    p.add_argument("input")
    p.add_argument("output")
    p.add_argument("--seq-length", type=positive, required=True)
    p.add_argument("--size")
    p.add_argument("--chunk", type=int, default=0)
    return top


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(args)
    a.run(ship(spark or SparkSession.builder.appName("readspark").getOrCreate()), a)


if __name__ == "__main__":
    main()
