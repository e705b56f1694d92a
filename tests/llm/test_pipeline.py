"""The corpus pipeline, stage by stage, against what each stage should do to its own input."""

import collections
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from shapeflow.llm.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"
WORDS = [a + b for a in ("ka", "lo", "mi", "nu", "pe", "ra") for b in ("b", "d", "g", "l", "m", "n", "r", "s")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    rng, at = random.Random(0), tmp_path_factory.mktemp("sf")
    item, passage = prose(rng, 25), prose(rng, 70)
    texts = {i: prose(rng, 100) for i in range(40)}
    texts |= {100 + i: "$$$ ### &&& " * 30 for i in range(20)}
    texts |= {200: texts[0], 201: texts[0], 202: " ".join(texts[1].split()[:-1] + ["x"])}
    texts |= {210: f"{prose(rng, 60)} {passage} {prose(rng, 60)}", 211: f"{prose(rng, 60)} {passage} {prose(rng, 60)}"}
    texts |= {220: f"{prose(rng, 60)} {item} {prose(rng, 60)}", 221: None}
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in texts.items()]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).withColumn("score", F.lit(7)).write.parquet(str(at / "documents.parquet"))
    spark.createDataFrame([(i, int(i < 100), 0) for i in texts if i < 140], "doc_id long, quality int, toxic int").write.parquet(str(at / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(at / "benchmark.parquet"))
    return str(at), texts, passage


def test_stages(spark, sf):
    at, texts, passage = sf
    docs, ids = spark.read.parquet(f"{at}/documents.parquet"), []
    columns = docs.columns
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, at)
        if n + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == columns, name
            docs = spark.createDataFrame(out.collect(), docs.schema)
            ids.append({r["doc_id"]: r["text"] for r in docs.collect()})
    assert {i for i in texts if i < 100 or i >= 200} - set(ids[0]) <= {221} and not any(100 <= i < 140 for i in ids[0])
    assert set(ids[0]) - set(ids[1]) == {200, 201, 202}
    assert set(ids[2]) == set(ids[1]) and passage in ids[2][210] and passage not in ids[2][211]
    assert all(ids[2][i] == t for i, t in ids[1].items() if i != 211)
    assert set(ids[2]) - set(ids[3]) == {220}
    taken = collections.Counter({r["doc_id"]: r["copies"] for r in out.collect()})
    assert set(taken) == set(ids[3]) and max(taken.values()) <= 3


def test_run_and_empty(spark, sf, tmp_path):
    at, _, _ = sf
    assert corpus_pipeline.run(spark, at).count() == 43
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{at}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_edges(spark, sf, tmp_path):
    """Null ids, repeated rows, ties, empty and very long texts, columns named like the result's."""
    at, texts, _ = sf
    rng = random.Random(9)
    long = prose(rng, 20_000)
    rows = [(i, t) for i, t in texts.items() if i < 10] + [(None, texts[11]), (300, ""), (301, None), (302, long), (303, long), (304, texts[12]), (304, texts[12]), (305, texts[12])]
    d = spark.createDataFrame([(i, t, "en", "s", len(t or ""), 5, 6) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, size int, copies int")
    d.write.parquet(str(tmp_path / "documents.parquet"))
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{at}/{t}.parquet").write.parquet(str(tmp_path / f"{t}.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = collections.Counter(r["doc_id"] for r in out)
    assert set(range(10)) <= set(ids) and ids[None] == 1 and ids[304] == 2 and 303 not in ids and 305 not in ids and ids[302] == 1
    assert len(out[0]) == len(set(out[0].asDict())) and all(r["taken"] == r["copies"] * r["size"] for r in out)
    assert next(r for r in out if r["doc_id"] == 302)["size"] == 20_000


@pytest.mark.skipif(not Path(SF).exists(), reason="test tables are not here")
@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    df = queries()[name](spark, SF)
    d = con.execute(oracle_sql()[name])
    names = [c[0] for c in d.description]
    assert sorted(df.columns) == sorted(names)
    plain = lambda v: round(v, 9) if isinstance(v, float) else v
    want = sorted(tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in d.fetchall())
    assert sorted(tuple(plain(r[c]) for c in sorted(names)) for r in df.collect()) == want
