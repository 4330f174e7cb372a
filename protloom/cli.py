"""Commands: ``index``, ``sketch``, ``kmers`` and ``search``."""

from __future__ import annotations

import argparse
import logging
import os
import sys

from pyspark.sql import DataFrame, SparkSession

from .config import MOLTYPES, kmer_size
from .index import ProteinIndex, SequenceSet, exists, index_filename
from .operators import kmers as km
from .operators import search as se
from .operators import stitch as st
from .sources.fasta import write_csv, write_fasta

logger = logging.getLogger("protloom")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="protloom")
    sub = p.add_subparsers(dest="command", required=True)
    index = sub.add_parser("index", help="store a FASTA file as an index")
    index.add_argument("-i", "--input", required=True)
    index.add_argument("-o", "--output")
    index.add_argument("-k", "--ksize", type=int, default=10)
    index.add_argument("-s", "--scaled", type=int, default=1)
    index.add_argument("-e", "--encoding", choices=MOLTYPES, default="protein")
    index.add_argument("-p", "--progress-interval", type=int, default=10_000)
    index.add_argument("--store-raw-sequences", action="store_true")
    for name, text, files in (("sketch", "make a file's sketch, and k-mers on request", ["fasta"]), ("search", "search the sketches of one file in another, or in a stored index", ["query", "target"]), ("kmers", "write a file's k-mers as a table and as CSV, and the records that have any as FASTA", ["fasta"])):
        one = sub.add_parser(name, help=text)
        for f in files:
            one.add_argument(f)
        one.add_argument("--moltype", choices=MOLTYPES, default="hp")
        one.add_argument("--ksize", type=int, default=24)
        one.add_argument("--scaled", type=int, default=5)
        for flag in ("--extract-kmers", "--debug", "--force"):
            one.add_argument(flag, action="store_true")
    sub.choices["search"].add_argument("--output")
    sub.choices["search"].add_argument("--search-csv", help="also keep the measures here when k-mers are extracted")
    return p


def search_index(spark: SparkSession, args: argparse.Namespace) -> None:
    """Against a stored index, whose settings hold; with its k-mers on request."""
    own = ProteinIndex.load(spark, args.target)
    query = SequenceSet(spark, args.query, own.ksize, own.scaled, own.moltype)
    rows = query.sequences()
    found = own.search(rows, ids=True)
    measures = found.drop("query_id", "match_id")
    if args.search_csv:
        write_csv(measures, args.search_csv)
    if not args.extract_kmers:
        write_csv(measures.orderBy("query_name", "match_name"), args.output)
        return
    query_kmers = km.kmer_positions(own.prepared(rows), own.ksize, own.moltype, own.scaled)
    shown(se.search_hits(found.select("query_id", "match_id"), se.kmer_hits(query_kmers, own.kmers())), args.output)


def shown(hits: DataFrame, output: str | None) -> None:
    """Stitched hits: as text on standard error, as CSV in the output."""
    rows = st.shown(st.stitch(hits)).orderBy("query_start", "query_end", "match_name").persist()
    for r in rows.select("to_print").toLocalIterator():
        print(r[0], file=sys.stderr)
    write_csv(rows.drop("to_print"), output)
    rows.unpersist()


def search(spark: SparkSession, args: argparse.Namespace) -> None:
    if exists(spark, f"{args.target}/metadata"):
        search_index(spark, args)
        return
    kw = {"ksize": args.ksize, "scaled": args.scaled, "moltype": args.moltype, "extract_kmers": args.extract_kmers, "force": args.force}
    query, target = SequenceSet(spark, args.query, **kw), SequenceSet(spark, args.target, **kw)
    found = se.manysearch(query.collection(), target.collection(), args.ksize, args.scaled, args.moltype, ids=True)
    measures = found.drop("query_id", "match_id")
    if args.search_csv:
        write_csv(measures, args.search_csv)
    if not args.extract_kmers:
        write_csv(measures.orderBy("query_name", "match_name"), args.output)
        return
    hits = se.search_hits(found.select("query_id", "match_id"), se.kmer_hits(query.kmers(), target.kmers()))
    shown(hits, args.output)


def kmers(spark: SparkSession, args: argparse.Namespace) -> None:
    """``{sketch}.kmers.pq``, ``{sketch}.kmers.csv`` and ``{sketch}.fasta``."""
    own = SequenceSet(spark, args.fasta, args.ksize, args.scaled, args.moltype, True, args.force)
    export = own.kmer_export()
    write_csv(export.select("sequence_file", "sequence_name", "kmer", "hashval"), f"{own.sketch_path}.kmers.csv")
    write_fasta(own.matched_sequences(), f"{own.sketch_path}.fasta")
    logger.info("%d k-mers in %s.kmers.csv", export.count(), own.sketch_path)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    logging.basicConfig(stream=sys.stderr, level=logging.DEBUG if getattr(args, "debug", False) else logging.INFO)
    spark = SparkSession.builder.appName("protloom").getOrCreate()
    if args.command == "index":
        kmer_size(args.ksize)
        out = args.output or os.path.join(os.path.dirname(args.input), index_filename(os.path.basename(args.input), args.encoding, args.ksize, args.scaled))
        own = ProteinIndex(spark, out, args.ksize, args.scaled, args.encoding, args.store_raw_sequences)
        own.process_fasta(args.input)
        own.compact()
        logger.info("%s", own.stats())
    elif args.command == "sketch":
        own = SequenceSet(spark, args.fasta, args.ksize, args.scaled, args.moltype, args.extract_kmers, args.force)
        logger.info("%d rows in %s", own.sketch().count(), own.sketch_path)
        if args.extract_kmers:
            own.kmers()
    elif args.command == "kmers":
        kmers(spark, args)
    else:
        search(spark, args)
    return 0


if __name__ == "__main__":
    sys.exit(main())
