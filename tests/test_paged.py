"""Paged sources: whole tables, and streams that are stopped half-way and resume."""

from __future__ import annotations

import json
from functools import partial
from pathlib import Path

import pytest
from lodegraph.session import importable
from lodegraph.sources import paged

SIZE = 4


def listed(folder, account, token):
    """A page is SIZE ids of the account's file, oldest first; the token is the page's number."""
    at = int(token or 0)
    ids = json.loads((Path(folder) / f"{account}.json").read_text())
    return ids[at * SIZE : (at + 1) * SIZE], str(at + 1) if (at + 1) * SIZE < len(ids) else None


def fetched(folder, account, item):
    with (Path(folder) / "calls").open("a") as log:
        log.write(f"{item}\n")
    if (Path(folder) / f"broken-{item}").exists():
        raise OSError(f"no {item}")
    return {"title": f"{account} {item}", "words": len(item)}


def remote(folder, accounts=("a", "b"), **options):
    return paged.Remote(accounts, "title string, words int", partial(listed, str(folder)), partial(fetched, str(folder)), base=0.0, **options)


def put(folder, **ids):
    for account, items in ids.items():
        (Path(folder) / f"{account}.json").write_text(json.dumps(items))


@pytest.fixture
def home(spark, tmp_path):
    importable(spark)
    spark.sparkContext.environment["PYTHONPATH"] += f":{Path(__file__).parent}"
    return tmp_path


def run(spark, home, name, source):
    frame = spark.readStream.format(paged.register(spark, name, source)).load()
    q = frame.writeStream.format("parquet").option("path", f"{home}/out").option("checkpointLocation", f"{home}/at").trigger(availableNow=True).start()
    q.awaitTermination()
    return sorted(r.id for r in spark.read.parquet(f"{home}/out").collect())


def test_table(spark, home):
    put(home, a=[f"a{i}" for i in range(10)], b=[], c=["c0", "c0"])
    found = spark.read.format(paged.register(spark, "whole", remote(home, ("a", "b", "c")))).load()
    assert found.columns == ["account", "id", "title", "words", "error"] and found.rdd.getNumPartitions() == 4
    assert sorted((r.account, r.id, r.title, r.words) for r in found.collect()) == sorted([("a", f"a{i}", f"a a{i}", 2) for i in range(10)] + [("c", "c0", "c c0", 2)] * 2)
    assert spark.read.format(paged.register(spark, "bare", remote(home, ("b",)))).load().count() == 0


def test_failing_items(spark, home):
    put(home, a=["a0", "a1"])
    (home / "broken-a1").touch()
    kept = spark.read.format(paged.register(spark, "kept", remote(home, ("a",), keep_errors=True))).load()
    assert sorted((r.id, r.title, r.error) for r in kept.collect()) == [("a0", "a a0", None), ("a1", None, "no a1")]
    assert (home / "calls").read_text().split().count("a1") == 3
    with pytest.raises(Exception, match="no a1"):
        spark.read.format(paged.register(spark, "strict", remote(home, ("a",)))).load().collect()


def test_stream_resumes_after_a_failure(spark, home):
    first = [f"a{i}" for i in range(6)]
    put(home, a=first, b=["b0"])
    assert run(spark, home, "feed", remote(home)) == sorted([*first, "b0"])
    put(home, a=first + [f"a{i}" for i in range(6, 19)], b=["b0", "b1"])  # the last page of either grows
    (home / "broken-a13").touch()
    with pytest.raises(Exception, match="no a13"):
        run(spark, home, "feed", remote(home))
    (home / "broken-a13").unlink()
    put(home, a=[f"a{i}" for i in range(30)], b=["b0", "b1", "b2"])  # what came while the stream was down
    # Spark gives such a source one batch a run: first the failed one, with the very items it had, then what came since.
    assert run(spark, home, "feed", remote(home)) == sorted([f"a{i}" for i in range(19)] + ["b0", "b1"])
    want = sorted([f"a{i}" for i in range(30)] + ["b0", "b1", "b2"])
    assert run(spark, home, "feed", remote(home)) == want
    done = (home / "calls").read_text()
    assert run(spark, home, "feed", remote(home)) == want and (home / "calls").read_text() == done  # nothing is fetched twice
    put(home, c=["c0"])
    assert run(spark, home, "feed", remote(home, ("a", "b", "c"))) == sorted([*want, "c0"])


def test_a_listing_that_shrinks_is_an_error(spark, home):
    put(home, a=[f"a{i}" for i in range(6)], b=[])
    run(spark, home, "shrunk", remote(home))
    put(home, a=["a0"], b=[])
    with pytest.raises(Exception, match="no longer listed|fewer items|StreamingQueryException|index|Illegal"):
        run(spark, home, "shrunk", remote(home))
