"""Command-line programs over files and sockets: one subcommand for each analysis.

    python -m milldam.cli itemsets 1 4 baskets.csv report.txt
"""

from __future__ import annotations

import argparse
import json
import time
from collections.abc import Callable
from pathlib import Path

from pyspark.ml.feature import StringIndexer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import attribute_words
from .operators import explore, graph, itemsets, recommend, similarity
from .session import saved, session, shared_dir
from .sources import readers, sinks
from .streaming import programs


def _lines(df: DataFrame, path: str) -> None:
    """A small, already aggregated report as one text file; rows arrive one after the other."""
    with open(path, "w") as f:
        for row in df.toLocalIterator():
            f.write(row[0] + "\n")


def users(spark: SparkSession, source: str, target: str, since: str = "2011") -> None:
    """Totals and the two top lists of a JSON-lines file of users, as one JSON object."""
    rows = readers.json_lines(spark, source, readers.USER).cache()
    top = explore.user_summary(rows, since).first().asDict()
    top["top_names"] = [list(r) for r in explore.top_names(rows).collect()]
    top["top_reviewers"] = [list(r) for r in explore.top_reviewers(rows).collect()]
    Path(target).write_text(json.dumps(top))


def partitions(spark: SparkSession, source: str, target: str, n: str) -> None:
    """Items per partition as read and after dealing by user, with the seconds that ten rows take."""
    rows = readers.json_lines(spark, source, readers.USER)
    out = {}
    for name, df in (("default", rows), ("customized", rows.repartition(int(n), "user_id"))):
        start = time.time()
        df.orderBy(F.desc("review_count")).limit(10).collect()
        took = time.time() - start
        items = [r["n_items"] for r in explore.partition_profile(df).orderBy("partition").collect()]
        out[name] = {"n_partition": len(items), "n_items": items, "exe_time": took}
    Path(target).write_text(json.dumps(out))


def states(spark: SparkSession, reviews: str, businesses: str, target: str, timing: str) -> None:
    """Mean stars by state as CSV, and seconds for collecting all against taking five."""
    out = explore.state_averages(readers.json_lines(spark, businesses, readers.BUSINESS), readers.json_lines(spark, reviews, readers.REVIEW))
    sinks.write_csv(out, target)
    both = {r["method"]: r["seconds"] for r in explore.collect_or_take(out).collect()}
    Path(timing).write_text(json.dumps({"m1": both["collect"], "m2": both["take"]}))


def _sets(rows: DataFrame, support: int, target: str, more_than: int = 0) -> None:
    own = saved(itemsets.baskets(rows, "key", "item", more_than), "baskets")
    candidates = itemsets.local_candidates(own, support)
    Path(target).write_text(sinks.itemset_report(candidates, itemsets.frequent(own, support)))


def frequent(spark: SparkSession, case: str, support: str, source: str, target: str) -> None:
    """Itemsets of a two-column CSV; case 1 groups by the first column, case 2 by the second."""
    key, item = ("user_id", "business_id") if case == "1" else ("business_id", "user_id")
    rows = readers.csv_rows(spark, source, readers.BASKET)
    _sets(rows.select(F.col(key).alias("key"), F.col(item).alias("item")), int(support), target)


def retail(spark: SparkSession, more_than: str, support: str, source: str, target: str) -> None:
    """Itemsets of a sales file: baskets of a customer and day with more than so many products."""
    _sets(readers.retail_baskets(spark, source), int(support), target, int(more_than))


def similar(spark: SparkSession, source: str, method: str, target: str) -> None:
    """Pairs of items rated by much the same users, as CSV."""
    rows = readers.ratings(spark, source)
    members = saved(rows.select(F.col("business_id").alias("item"), F.pmod(F.xxhash64("user_id"), F.lit(2_147_483_629)).alias("member")), "members")
    out = similarity.similar_items(members, 13, 2, 0.5, method)
    names = {"a": "business_id_1", "b": "business_id_2"}
    sinks.write_csv(out.withColumnsRenamed(names).orderBy("business_id_1", "business_id_2"), target)


def _pairs(spark: SparkSession, train: str, test: str) -> tuple[DataFrame, DataFrame]:
    shape = {"user_id": "u", "business_id": "i", "stars": "r"}
    known = readers.ratings(spark, train).withColumnsRenamed(shape)
    asked = readers.csv_rows(spark, test, "user_id string, business_id string").withColumnsRenamed(shape)
    return saved(known, "train"), saved(asked, "test")


def _factors(train: DataFrame, test: DataFrame, penalty: float) -> DataFrame:
    """Factor predictions for string keys, over numbers that both tables share."""
    both = train.select("u", "i").unionByName(test.select("u", "i"))
    model = StringIndexer(inputCols=["u", "i"], outputCols=["un", "in"]).fit(both)
    number = lambda df, *more: model.transform(df).select(F.col("un").cast("int").alias("u"), F.col("in").cast("int").alias("i"), *more)
    found = recommend.als_predictions(number(train, "r"), number(test), penalty=penalty).withColumnsRenamed({"u": "un", "i": "in"})
    keys = model.transform(test).select("u", "i", F.col("un").cast("int").alias("un"), F.col("in").cast("int").alias("in"))
    return keys.join(found.dropDuplicates(["un", "in"]), ["un", "in"]).select("u", "i", "prediction")


def _predictions(out: DataFrame, target: str) -> None:
    sinks.write_csv(out.withColumnsRenamed({"u": "user_id", "i": "business_id"}), target)


def predict(spark: SparkSession, train: str, test: str, case: str, target: str) -> None:
    """Predicted ratings: case 1 by factors, 2 by similar users, 3 by similar items."""
    known, asked = _pairs(spark, train, test)
    if case == "1":
        out = _factors(known, asked, 0.2)
    elif case == "2":
        out = recommend.user_predictions(known, asked)
    elif case == "3":
        members = known.select(F.col("i").alias("item"), F.pmod(F.xxhash64("u"), F.lit(2_147_483_629)).alias("member"))
        out = recommend.item_predictions(known, asked, similarity.similar_items(members, 8, 1, 0.5))
    else:
        raise ValueError("case must be 1, 2 or 3")
    _predictions(out, target)


def hybrid(spark: SparkSession, folder: str, train: str, test: str, target: str) -> None:
    """Predicted ratings by the blend of four models; the folder holds business.json and the ratings file ``train``."""
    known, asked = _pairs(spark, f"{folder}/{train}", test)
    business = readers.json_lines(spark, f"{folder}/business.json", readers.BUSINESS_CONTENT)
    words = business.select(F.col("business_id").alias("i"), attribute_words(F.col("attributes"), F.col("categories")).alias("words"))
    parts = {
        "content": recommend.content_predictions(known, asked, words),
        "user": recommend.user_predictions(known, asked, positive=True),
        "als": _factors(known, asked, 0.3),
        "baseline": recommend.baseline_predictions(known, asked),
    }
    _predictions(recommend.blended({k: saved(v, k) for k, v in parts.items()}), target)


def divisive(spark: SparkSession, source: str, betweenness: str, target: str) -> None:
    """Edge betweenness, and the communities of the best split by removing edges."""
    edges = readers.edges(spark, source)
    _lines(sinks.betweenness_lines(graph.edge_betweenness(edges)), betweenness)
    _lines(sinks.community_lines(graph.communities(graph.girvan_newman(edges), "community")), target)


def propagation(spark: SparkSession, source: str, target: str) -> None:
    """Communities by five rounds of label propagation."""
    found = graph.label_propagation(readers.edges(spark, source))
    _lines(sinks.community_lines(graph.communities(found, "label")), target)


def _state(spark: SparkSession, name: str, port: str) -> str:
    return f"{shared_dir(spark)}/{name}-{port}"


def bloom(spark: SparkSession, port: str, target: str, host: str = "localhost", seconds: str = "10") -> None:
    """The filter's false-positive rate over a socket of JSON lines with ``state``, a CSV row per batch."""
    stream = readers.socket_json(spark, host, int(port), "state string")
    programs.bloom(stream, target, _state(spark, "bloom", port), processingTime=f"{seconds} seconds").awaitTermination()


def distinct(spark: SparkSession, port: str, target: str, host: str = "localhost", seconds: str = "5") -> None:
    """Distinct cities over a socket of JSON lines, per sliding window of 30 s every 10 s."""
    stream = readers.socket_json(spark, host, int(port), "city string").withColumnRenamed("city", "key")
    programs.distinct(stream, target, _state(spark, "distinct", port), processingTime=f"{seconds} seconds").awaitTermination()


def sample(spark: SparkSession, port: str, target: str, host: str = "localhost", seconds: str = "10") -> None:
    """The most frequent tags of a sample of 150 posts over a socket of JSON lines, a CSV per batch."""
    stream = programs.posts(readers.socket_json(spark, host, int(port), programs.POST))
    programs.sampled_tags(stream, target, _state(spark, "sample", port), processingTime=f"{seconds} seconds").awaitTermination()


COMMANDS: dict[str, Callable[..., None]] = {
    "users": users, "partitions": partitions, "states": states, "itemsets": frequent, "retail": retail, "similar": similar, "predict": predict,
    "hybrid": hybrid, "divisive": divisive, "propagation": propagation, "bloom": bloom, "distinct": distinct, "sample": sample,
}


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="milldam", epilog="\n".join(f"{k}: {f.__doc__}" for k, f in COMMANDS.items()), formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("command", choices=COMMANDS)
    parser.add_argument("arguments", nargs="*")
    given = parser.parse_args(argv)
    start = time.time()
    COMMANDS[given.command](session(), *given.arguments)
    print(f"Duration: {time.time() - start:.1f}")


if __name__ == "__main__":
    main()
