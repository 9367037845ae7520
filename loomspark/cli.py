"""Programs by name: python -m loomspark.cli -program ngramcount -input in -output out -n 2"""

from __future__ import annotations

import argparse
import sys

from loomspark.operators import cooccur, graph, kmeans, langmodel, ngrams
from loomspark.session import get_session
from loomspark.sources import points, text


def ngramcount(spark, o) -> None:
    text.write_tsv(ngrams.ngram_counts(text.read_lines(spark, *o.input.split(",")), o.n), o.output)


def hashtagsim(spark, o) -> None:
    text.write_tsv(cooccur.tag_similarity(cooccur.word_tag_counts(text.read_lines(spark, *o.input.split(",")))), o.output)


def features(spark, o) -> None:
    text.write_tsv(cooccur.feature_vector(cooccur.word_tag_counts(text.read_lines(spark, *o.input.split(","))), o.tag), o.output)


def nextword(spark, o) -> None:
    text.write_table(langmodel.next_word(text.read_ngrams(spark, o.input), o.top), o.output, "prefix")


def nextphrase(spark, o) -> None:
    text.write_table(langmodel.next_phrase(text.read_ngrams(spark, o.input)), o.output, "phrase")


def pagerank(spark, o) -> None:
    text.write_tsv(graph.pagerank(text.read_edges(spark, o.input), o.n), o.output)


def cluster(spark, o) -> None:
    read = points.read_binary_points if o.binary else points.read_text_points
    rows = read(spark, o.input)
    fitted = kmeans.kmeans(rows, o.n, threshold=o.threshold, init=o.init, min_size=o.minsize, least_passes=o.passes)
    points.write_centres(fitted.table(spark), o.output + ".cluster_centres")
    points.write_membership(fitted.membership(rows), o.output + ".membership")


PROGRAMS = {"ngramcount": ngramcount, "hashtagsim": hashtagsim, "features": features, "nextword": nextword, "nextphrase": nextphrase, "pagerank": pagerank, "kmeans": cluster}
#: Options a program can't do without, but for -input and -output.
NEEDED = {"ngramcount": ["n"], "pagerank": [], "kmeans": ["n"]}


def options(args: list[str]) -> argparse.Namespace:
    """Unknown options are ignored; a missing one ends the program with status 1."""
    p = argparse.ArgumentParser(prefix_chars="-", add_help=False, allow_abbrev=False)
    for name in ("program", "input", "output", "tmpdir", "tag"):
        p.add_argument(f"-{name}")
    p.add_argument("-n", type=int)
    p.add_argument("-top", type=int, default=5)
    p.add_argument("-threshold", type=float, default=0.001)
    p.add_argument("-binary", action="store_true")
    p.add_argument("-init", choices=sorted(kmeans.SEEDINGS), default="first")
    p.add_argument("-minsize", type=int, default=1)
    p.add_argument("-passes", type=int, default=1)
    o, _ = p.parse_known_args(args)
    missing = [x for x in ("program", "input", "output", *NEEDED.get(o.program, [])) if getattr(o, x) is None]
    if missing or o.program not in PROGRAMS:
        print(f"missing or unknown: {', '.join(missing) or o.program}; programs: {', '.join(PROGRAMS)}", file=sys.stderr)
        raise SystemExit(1)
    if o.program == "pagerank" and o.n is None:
        o.n = 10
    o.tag = o.tag or "#job"
    return o


def main(args: list[str] | None = None, spark=None) -> None:
    o = options(sys.argv[1:] if args is None else args)
    PROGRAMS[o.program](spark or get_session(app=o.program), o)


if __name__ == "__main__":
    main()
