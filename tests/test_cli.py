"""The programs on small files."""

from __future__ import annotations

import csv
import json
import random
from pathlib import Path

import pytest

from milldam import cli


def table(folder):
    rows = []
    for p in sorted(Path(folder).glob("part-*.csv")):
        with p.open() as f:
            rows += list(csv.DictReader(f))
    return rows


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    d = tmp_path_factory.mktemp("in")
    r = random.Random(1)
    users = [{"user_id": f"u{i}", "name": r.choice(["Ann", "Bo"]), "review_count": i, "since": f"20{10 + i % 3}-01-01"} for i in range(12)]
    (d / "user.json").write_text("\n".join(map(json.dumps, users)))
    shops = [{"business_id": f"b{i}", "state": "XY"[i % 2], "categories": "Bars, Food", "attributes": {"wifi": "True", "price": str(i % 3)}} for i in range(6)]
    (d / "business.json").write_text("\n".join(map(json.dumps, shops)))
    (d / "review.json").write_text("\n".join(json.dumps({"business_id": f"b{i % 6}", "stars": float(1 + i % 5)}) for i in range(30)))
    (d / "baskets.csv").write_text("user_id,business_id\n" + "\n".join(f"{u},{b}" for u, items in (("1", "123"), ("2", "12"), ("3", "13"), ("4", "123")) for b in items))
    (d / "train.csv").write_text("user_id,business_id,stars\n" + "\n".join(f"u{u},b{b},{r.randint(1, 5)}.0" for u in range(12) for b in range(6) if (u + b) % 3))
    (d / "test.csv").write_text("user_id,business_id,stars\n" + "\n".join(f"u{u},b{b},3.0" for u in range(12) for b in range(6) if not (u + b) % 3) + "\nnobody,b1,3.0")
    (d / "edges.txt").write_text("a b\na c\nb c\nd e\nd f\ne f\nc d\n")
    (d / "sales.csv").write_text('"D","C","x","y","z","P"\n' + "\n".join(f'"d{i}","c","","","","{p}"' for i in range(3) for p in (1, 2, 3)))
    return d


def test_users(spark, files, tmp_path):
    cli.users(spark, str(files / "user.json"), str(tmp_path / "o"))
    out = json.loads((tmp_path / "o").read_text())
    assert (out["n_users"], out["n_since"], out["n_reviews"], out["n_names"]) == (12, 4, 66, 2)
    assert out["top_reviewers"][0] == ["u11", 11]


def test_partitions(spark, files, tmp_path):
    cli.partitions(spark, str(files / "user.json"), str(tmp_path / "o"), "3")
    out = json.loads((tmp_path / "o").read_text())
    assert out["customized"]["n_partition"] == 3 and sum(out["customized"]["n_items"]) == 12


def test_states(spark, files, tmp_path):
    cli.states(spark, str(files / "review.json"), str(files / "business.json"), str(tmp_path / "o"), str(tmp_path / "t"))
    assert [r["state"] for r in table(tmp_path / "o")] == ["X", "Y"]
    assert set(json.loads((tmp_path / "t").read_text())) == {"m1", "m2"}


def test_itemsets(spark, files, tmp_path):
    cli.frequent(spark, "1", "2", str(files / "baskets.csv"), str(tmp_path / "o"))
    assert (tmp_path / "o").read_text().split("Frequent Itemsets:\n")[1] == "('1'), ('2'), ('3')\n\n('1', '2'), ('1', '3'), ('2', '3')\n\n('1', '2', '3')"
    cli.retail(spark, "2", "3", str(files / "sales.csv"), str(tmp_path / "r"))
    assert (tmp_path / "r").read_text().endswith("('1', '2', '3')")


def test_similar(spark, files, tmp_path):
    cli.similar(spark, str(files / "train.csv"), "jaccard", str(tmp_path / "o"))
    assert all(r["business_id_1"] < r["business_id_2"] and float(r["similarity"]) >= 0.5 for r in table(tmp_path / "o"))


@pytest.mark.parametrize("case", ["1", "2", "3"])
def test_predict(spark, files, tmp_path, case):
    cli.predict(spark, str(files / "train.csv"), str(files / "test.csv"), case, str(tmp_path / "o"))
    rows = table(tmp_path / "o")
    assert len(rows) == 25 and all(1 <= float(r["prediction"]) <= 5 for r in rows)
    assert [float(r["prediction"]) for r in rows if r["user_id"] == "nobody"] == [3.0]


def test_hybrid(spark, files, tmp_path):
    cli.hybrid(spark, str(files), "train.csv", str(files / "test.csv"), str(tmp_path / "o"))
    assert len(table(tmp_path / "o")) == 25


def test_graphs(spark, files, tmp_path):
    cli.divisive(spark, str(files / "edges.txt"), str(tmp_path / "b"), str(tmp_path / "c"))
    assert (tmp_path / "b").read_text().splitlines()[0] == "('c', 'd'), 9.0"
    assert (tmp_path / "c").read_text().splitlines() == ["'a', 'b', 'c'", "'d', 'e', 'f'"]
    cli.propagation(spark, str(files / "edges.txt"), str(tmp_path / "p"))
    assert sum(line.count("'") // 2 for line in (tmp_path / "p").read_text().splitlines()) == 6
