"""Command line: ``python -m verbaspark [--lang en-US] TEXT...`` speaks texts, or lines of the standard input where none is given.

``--batch`` answers request lines of the batch protocol instead. ``--input`` and ``--output`` speak the lines of files by Spark,
``--parity`` judges recorded cases of JSON documents in a folder, and ``--classes`` those of case files by class.
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Iterable, Sequence
from typing import TextIO

from verbaspark import api
from verbaspark.sources import protocol


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="verbaspark", description="Written text to spoken form.")
    p.add_argument("text", nargs="*", help="texts; without any, lines of the standard input")
    p.add_argument("--lang", default="en-US", help="locale, such as es-MX")
    p.add_argument("--input-case", default="cased", choices=["cased", "lower_cased"])
    p.add_argument("--max-permutations", type=int, default=729, help="orders of fields in a group of tokens, at most")
    p.add_argument("--punct-pre-process", action="store_true", help="spaces around square brackets first")
    p.add_argument("--no-punct-post-process", action="store_true", help="leave spaces around marks as they come")
    p.add_argument("--batch", action="store_true", help="request lines in, reply lines out")
    p.add_argument("--input", help="text files whose lines Spark speaks")
    p.add_argument("--output", help="folder for the spoken lines")
    p.add_argument("--parity", metavar="PATH", help="JSON documents of recorded cases")
    p.add_argument("--classes", metavar="PATTERN", help="case files, as <lang>/<class>.txt")
    return p


def _speak(lines: Iterable[str], options: argparse.Namespace, out: TextIO) -> None:
    normalizer = api.Normalizer(options.lang, options.input_case, True, options.max_permutations)
    for line in lines:
        said = normalizer.normalize(line.rstrip("\n"), options.punct_pre_process, not options.no_punct_post_process)
        print(said, file=out, flush=True)


def _by_spark(options: argparse.Namespace) -> None:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from verbaspark.operators import multilingual
    from verbaspark.plans import parity
    from verbaspark.sources import readers

    spark = SparkSession.builder.appName("verbaspark").getOrCreate()
    if options.input:
        lines = readers.lines(spark, options.input)
        multilingual.normalize(lines, F.lit(api.language_of(options.lang))).select(F.col("spoken").alias("value")).write.text(options.output)
    if options.parity:
        parity.tally(parity.judged(parity.recorded(spark, options.parity))).show(1000, False)
    if options.classes:
        parity.tally(parity.classes(spark, options.classes)).show(1000, False)


def main(arguments: Sequence[str] | None = None, lines: TextIO = sys.stdin, out: TextIO = sys.stdout) -> int:
    p = parser()
    options = p.parse_args(arguments)
    if bool(options.input) != bool(options.output):
        p.error("--input and --output go together")
    try:
        if options.input or options.parity or options.classes:
            _by_spark(options)
        elif options.batch:
            for line in lines:
                print(protocol.reply_one(line.rstrip("\n")), file=out, flush=True)
        else:
            _speak(options.text or lines, options, out)
    except (ValueError, RuntimeError) as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
