import json

import pytest

from lodeline.collection import Collection
from lodeline.operators import evaluate, metadata, skew
from lodeline.operators.usable import usable
from lodeline.plans.strategy import AutoTunerConfig, decide_mode, detect_ram_gb, mode_of


def test_enrich(spark):
    rows = ['{"b":1,"a":{"x":[1,2]}}', "not json", "", None, "[1,2]", '"s"', "3", '{"__id__":"old"}', "{}"]
    d = spark.createDataFrame([(m,) for m in rows], "metadata string").selectExpr("metadata", "'i1' AS ext_id").coalesce(1)
    got = [r[0] for r in d.select(metadata.enrich("metadata", "ext_id")).collect()]
    assert got == ['{"__id__":"i1","a":{"x":[1,2]},"b":1}', '{"__id__":"i1"}', '{"__id__":"i1"}', '{"__id__":"i1"}', "[1,2]", '"s"', "3", '{"__id__":"i1"}', '{"__id__":"i1"}']


def test_salted_aggregate_with_one_hot_key(spark):
    d = spark.range(1000).selectExpr("if(id < 900, 1, if(id < 950, null, id)) AS k", "id", "cast(id AS double) AS x", "'y' AS n")
    assert skew.heavy_keys(d, "k", ["id"], 0.1) == [1]
    from pyspark.sql import functions as F

    got = {r.k: r for r in skew.salted_aggregate(d, "k", {"n": ("count", F.lit(1)), "s": ("sum", F.col("x")), "m": ("mean", F.col("x")), "top": ("max", F.col("x"))}, ["id"], share=0.1).collect()}
    assert (got[1].n, got[1].s, got[1].m, got[1].top) == (900, 404550.0, 449.5, 899.0)
    assert got[None].n == 50 and len(got) == 52
    assert skew.salted_aggregate(d.limit(0), "k", {"n": ("count", F.lit(1))}, ["id"]).count() == 0


def test_partition_sizes_and_means(spark):
    a = spark.createDataFrame([(1, 0, None), (1, 0, None), (2, 0, None), (3, -1, None), (4, None, None), (None, 0, None)], "vec_id bigint, cid int, assigned_at timestamp")
    assert {r.cid: (r.n_rows, round(r.share, 3)) for r in skew.partition_sizes(a).collect()} == {0: (4, 0.667)}
    v = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 4.0])], "vec_id bigint, embedding array<float>")
    assert {r.pos: (r.mean, r.n_vectors) for r in skew.partition_means(a, v).collect()} == {0: (2.0, 2), 1: (3.0, 2)}
    assert skew.partition_sizes(a.limit(0)).count() == 0


def test_usable(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0], 1), (1, None, 2), (2, None, 1), (2, [1.0, 0.0], 2), (3, [0.0, 0.0], 1), (4, [nan, 1.0], 1), (5, [inf, 1.0], 1), (6, [1.0], 1), (7, [1.0, None], 1), (8, [2.0, 0.0], None), (8, [1.0, 1.0], 1), (None, [1.0, 1.0], 1), (9, [1.0, 1.0], 1), (9, [1.0, 1.0], 1), (10, [-inf, 1.0], 1)]
    d = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, ingested_at int").selectExpr("*", "1 AS __at", "2 AS n")
    assert sorted((r.vec_id, r.embedding) for r in usable(d, 2).collect()) == [(2, [1.0, 0.0]), (8, [1.0, 1.0]), (9, [1.0, 1.0])]


def test_percentile_index(spark):
    d = spark.createDataFrame([(float(i % 7),) for i in range(50)] + [(None,)], "x double")
    for p in (0, 50, 99, 100):
        v = sorted(float(i % 7) for i in range(50))
        assert evaluate.percentile_index(d, "x", p).first()[0] == v[min(49, 50 * p // 100)]
    assert evaluate.percentile_index(d.where("x > 99"), "x", 50).count() == 0


def test_strategy():
    assert decide_mode(10_000) == "flat" and decide_mode(60_000, AutoTunerConfig(4)) == "sq8" and decide_mode(60_000, AutoTunerConfig(16)) == "hnsw"
    assert mode_of("SCALAR") == "sq8" and detect_ram_gb("/none") == 4.0
    with pytest.raises(ValueError):
        mode_of("tree")


def vec(i, dim=128):
    return [1.0 if j == i % dim else 0.01 * (i % 5) for j in range(dim)]


@pytest.mark.parametrize("mode", ["flat", "hnsw", "sq8", "ivf", "auto"])
def test_collection_modes(spark, tmp_path, mode):
    c = Collection(str(tmp_path / mode), 128, mode, spark=spark)
    assert c.add([f"d{i}" for i in range(60)], [vec(i) for i in range(60)], ['{"k": %d}' % i if i % 2 else "meta" for i in range(60)]) == 60
    if mode == "ivf":
        c.configure_ivf(4, 4)
        c.train_ivf()
    assert c.search(vec(7), 3)[0][0] == "d7"
    assert c.delete(["d7", "none"]) == 1 and c.count() == 59
    assert "d7" not in [i for i, _ in c.search(vec(7), 5)]
    again = Collection(str(tmp_path / mode), 128, spark=spark)
    assert again.mode == mode and json.loads(again.get("d9")) == {"__id__": "d9", "k": 9} and json.loads(again.get("d8")) == {"__id__": "d8"}
    assert again.add(["d7"], [vec(7)], [""]) == 1 and again.search(vec(7), 1)[0][0] == "d7"


def test_collection_checks(spark, tmp_path):
    for dim in (64, 5000, 50):
        with pytest.raises(ValueError):
            Collection(str(tmp_path / "x"), dim, spark=spark)
    c = Collection(str(tmp_path / "y"), 128, spark=spark)
    assert c.search(vec(1), 3) == [] and c.count() == 0
    with pytest.raises(ValueError, match="64.*128"):
        c.add(["a"], [[1.0] * 64], [""])
    with pytest.raises(ValueError):
        c.add(["a", "a"], [vec(1), vec(2)], ["", ""])
    with pytest.raises(ValueError):
        c.add(["a"], [vec(1)], [])
    c.add(["a"], [vec(1)], [""])
    with pytest.raises(ValueError):
        c.add(["a"], [vec(1)], [""])
    with pytest.raises(ValueError):
        c.get("b")
    with pytest.raises(ValueError):
        c.train_ivf()
    assert c.count() == 1 and [r[0] for r in c.get_all_ids().collect()] == ["a"] and c.get_range(0, 1).count() == 1


def test_collection_pq_and_graph_over_codes(spark, tmp_path):
    rows = [vec(i) for i in range(40)]
    for make, name in ((Collection.new_product_quantized, "p"), (Collection.new_hnsw_quantized, "h")):
        c = make(str(tmp_path / name), 128, rows, spark=spark)
        c.add([str(i) for i in range(40)], rows, [""] * 40)
        assert "3" in [i for i, _ in c.search(rows[3], 5)]
    with pytest.raises(ValueError):
        Collection.new_scalar_quantized(str(tmp_path / "s"), 128, [], spark=spark)


def test_stream(spark, tmp_path):
    from lodeline.streaming.ingest import ingest

    c = Collection(str(tmp_path / "c"), 128, spark=spark)
    src = spark.createDataFrame([("a", vec(1), ""), ("a", vec(1), ""), ("b", vec(2), "{}"), (None, vec(3), ""), ("c", [1.0], "")], "ext_id string, embedding array<float>, metadata string")
    src.write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    ingest(s, c, str(tmp_path / "ck")).awaitTermination()
    assert sorted(r[0] for r in c.get_all_ids().collect()) == ["a", "b"]


def test_commit_is_never_without_a_manifest(spark, tmp_path):
    """A writer that ends before or after its rename leaves a collection that opens with all its rows."""
    path = tmp_path / "c"
    c = Collection(str(path), 128, spark=spark)
    c.add(["a"], [vec(1)], [""])
    (path / "manifest.new").write_text("{ half of a")
    assert Collection(str(path), 128, spark=spark).count() == 1
    rename = c.store._fs.rename

    class Broken:
        def __getattr__(self, name):
            return getattr(fs, name)

        def rename(self, *_):
            raise OSError("the writer ended")

    fs, c.store._fs = c.store._fs, Broken()
    with pytest.raises(OSError):
        c.add(["b"], [vec(2)], [""])
    again = Collection(str(path), 128, spark=spark)
    assert again.count() == 1 and again.add(["b"], [vec(2)], [""]) == 1 and rename is not None
    assert len(list(path.glob("manifest-*.json"))) == 2


def test_rows_of_a_shuffled_source_are_numbered_once(spark, tmp_path):
    c = Collection(str(tmp_path / "c"), 128, spark=spark)
    d = spark.range(500).selectExpr("cast(id AS string) AS ext_id", "transform(sequence(1, 128), i -> cast(rand() AS float)) AS embedding", "'' AS metadata").repartition(7)
    assert c.add(d) == 500
    assert sorted(r[0] for r in c.get_range(0, 1000).select("vec_id").collect()) == list(range(500))
    assert c.add(d.selectExpr("concat('x', ext_id) AS ext_id", "embedding", "metadata").orderBy("ext_id")) == 500 and c.get_range(500, 500).count() == 500


def test_metadata_set_and_indexes_grow(spark, tmp_path):
    c = Collection(str(tmp_path / "c"), 128, "sq8", spark=spark)
    assert c.set_metadata(["a"], ["{}"]) == 0
    c.add([str(i) for i in range(20)], [vec(i) for i in range(20)], [""] * 20)
    assert c.set_metadata(["3", "none"], ['{"k":1}', "{}"]) == 1 and json.loads(c.get("3")) == {"__id__": "3", "k": 1} and c.metadata_count() == 20
    assert c.search(vec(3), 1)[0][0] == "3"
    parts = list(c.store.manifest["tables"]["sq8_codes"])
    c.add(["in"], [[0.02] * 128], [""])
    c.search(vec(3), 1)
    assert c.store.manifest["tables"]["sq8_codes"][:-1] == parts  # appended
    c.add(["out"], [[9.0] * 128], [""])
    assert c.search([9.0] * 128, 2)[0][0] in ("out", "in") and len(c.store.manifest["tables"]["sq8_codes"]) == 1  # beyond the range: all again
    assert c.get_codes(0, 5, "sq8").count() == 5


def test_percentiles(spark):
    d = spark.createDataFrame([(float(x),) for x in (5, 1, 1, 2, 9)] + [(None,)], "x double")
    assert evaluate.percentiles(d, "x", (0.5, 0.9)).first()[:] == (2.0, 7.4)
    assert evaluate.percentiles(d.limit(0), "x").first()[:] == (None, None)
    skewed = spark.range(20000).selectExpr("if(id = 0, 1e9D, cast(id AS double) / 1e6) AS x")
    assert evaluate.percentile_index(skewed, "x", 50).first()[0] == 10001 / 1e6


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from lodeline.plans import runtime

    class Session:
        conf = type("C", (), {"get": staticmethod(lambda *_: None)})
        sparkContext = type("S", (), {"master": "spark://host:7077"})

    with pytest.raises(RuntimeError, match="checkpoint"):
        runtime.shared_dir(Session)
