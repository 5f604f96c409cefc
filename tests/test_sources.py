import json
import random

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moderata.functions import labels as lb
from moderata.plans.catalog import QUERIES
from moderata.sources import index_store, registry
from moderata.sources.delimited import read_delimited
from moderata.sources.tables import NULL_WORDS, page_documents, read_tsv, read_with_row_id
from moderata.streaming import files


def write(df, path):
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def test_row_ids_are_unique_and_stable(spark, tmp_path):
    spark.range(100).repartition(3).write.parquet(str(tmp_path / "t"))
    first = read_with_row_id(spark, str(tmp_path / "t"))
    assert first.select("row_id").distinct().count() == 100
    again = read_with_row_id(spark, str(tmp_path / "t")).repartition(5)
    assert sorted(map(tuple, first.collect())) == sorted(map(tuple, again.collect()))


def test_registry_reads_every_dataset(spark, tmp_path):
    base = str(tmp_path)
    statements = spark.createDataFrame(
        [("p", 1, "g1", "m"), ("p", 0, None, "m"), (None, 0, "g3", "m"), ("p", 0, "g4", "m")],
        "prompt string, prompt_label int, generation string, method string",
    )
    write(statements.withColumn("split", F.lit("train")), f"{base}/toxigen/train")
    scores = spark.createDataFrame([("x", 3.0, 3.0), ("y", 2.5, 3.0), ("z", None, 5.0)], "text string, toxicity_ai double, toxicity_human double")
    write(scores.withColumn("split", F.lit("train")).union(scores.withColumn("split", F.lit("test"))), f"{base}/toxigen/annotated")
    train, val = registry.load(spark, "toxigen", f"{base}/toxigen")
    assert sorted(map(tuple, train.select("text", "label").collect())) == [("g1", 1), ("g4", 0)]
    assert sorted(map(tuple, val.collect())) == [("x", 1), ("y", 0), ("z", 0)]
    registry.check_layout(train, registry.SUPERVISED)
    raw, _ = registry.load(spark, "toxigen_raw", f"{base}/toxigen")
    assert raw.count() == 4
    assert registry.load(spark, "toxigen_human", f"{base}/toxigen")[0].count() == 3
    good, held = registry.load(spark, "toxigen_preference", f"{base}/toxigen")
    registry.check_layout(good, registry.UNPAIRED)
    assert (good.count(), held.count()) == (1, 1)

    tweets = spark.range(50).select(F.concat(F.lit("t"), "id").alias("tweet"), (F.col("id") % 5 == 0).cast("int").alias("label"), F.lit("train").alias("split"))
    write(tweets, f"{base}/tweets")
    train, val = registry.load(spark, "twitter", f"{base}/tweets")
    assert (train.count(), val.count()) == (40, 10)
    train, val = registry.load(spark, "tweets", f"{base}/tweets")
    assert (val.where("label = 1").count(), val.count(), train.count()) == (2, 10, 40)

    comments = spark.createDataFrame([("a", 0.5), ("b", 0.51), ("c", None), (None, 0.9), ("d", float("nan"))], "text string, hate_speech_score double")
    write(comments.withColumn("split", F.lit("train")), f"{base}/comments")
    train, val = registry.load(spark, "berkeley", f"{base}/comments")
    assert sorted(map(tuple, train.union(val).collect())) == [("a", 0), ("b", 1), ("c", 0), ("d", 0)]
    assert val.count() == 1

    gender = spark.createDataFrame([("a", 2.0, "train"), ("b", 0.0, "train"), ("c", 1.0, "test"), (None, 1.0, "test")], "Text string, Label double, split string")
    write(gender, f"{base}/gender")
    train, val = registry.load(spark, "gender", f"{base}/gender")
    assert sorted(map(tuple, train.collect())) == [("a", 1), ("b", 0)]
    assert list(map(tuple, val.collect())) == [("c", 1)]
    with pytest.raises(KeyError):
        registry.load(spark, "nothing", base)
    with pytest.raises(TypeError):
        registry.check_layout(train, registry.PAIRED)


def test_split_folder_is_pruned(spark, tmp_path):
    write(spark.createDataFrame([("a", 1.0, "train"), ("c", 1.0, "test")], "Text string, Label double, split string"), str(tmp_path / "g"))
    train, _ = registry.load(spark, "gender", str(tmp_path / "g"))
    assert "PartitionFilters: [isnotnull(split" in train._jdf.queryExecution().executedPlan().toString()


def test_category_files(spark, tmp_path):
    header = "id\ttext\tlabels\n"
    (tmp_path / "train.tsv").write_text(header + '1\tplain\tNeutral\n2\t"two\nlines ""quoted"""\tSlur\n3\tNA\tSlur\n')
    (tmp_path / "dev.tsv").write_text(header + "4\tdev\t\n")
    (tmp_path / "test.tsv").write_text(header + "5\ttest\tNeutral\n")
    train, val = registry.load(spark, "cad", str(tmp_path))
    assert sorted(map(tuple, train.collect())) == [("dev", 1), ("plain", 0), ('two\nlines "quoted"', 1)]
    assert list(map(tuple, val.collect())) == [("test", 0)]
    raw = read_tsv(spark, str(tmp_path / "train.tsv"), registry.CATEGORY_FILE)
    assert raw.where("text is null").count() == 1 and "NA" in NULL_WORDS


def test_pages_by_seed_list(spark):
    pages = spark.createDataFrame([(1, "u1", "<p>x</p>"), (2, "u2", "<p>y</p>")], "page_id bigint, url string, html string")
    seeds = spark.createDataFrame([("u2",), ("u2",), ("u9",)], "url string")
    assert [tuple(r) for r in page_documents(pages, seeds).collect()] == [(2, "u2", "y")]
    assert page_documents(pages).count() == 2


def test_index_is_built_once_and_opened(spark, tmp_path):
    docs = spark.createDataFrame([(1, "one two. three four.", "en"), (2, "five", "de")], "doc_id bigint, text string, lang string")
    built = index_store.open_index(spark, str(tmp_path / "i"), docs, ["lang"])
    opened = index_store.open_index(spark, str(tmp_path / "i"))
    rows = lambda i: sorted((r.node_id, r.lang, sorted(r.terms)) for r in i.nodes.collect())
    assert rows(built) == rows(opened) == [
        ("1:0", "en", ["en", "four", "one", "three", "two"]), ("2:0", "de", ["de", "five"]),
    ]
    assert opened.manifest.first().n_nodes == 2


def test_json_manifest(spark, tmp_path):
    inner = {"index_id": "ix", "summary": None, "nodes_dict": {"n1": "n1", "n2": "n2"}, "doc_id_dict": {}}
    outer = {"index_store/data": {"ix": {"__type__": "vector_store", "__data__": json.dumps(inner)}}}
    (tmp_path / "m.json").write_text(json.dumps(outer))
    rows = index_store.read_json_manifest(spark, str(tmp_path / "m.json")).collect()
    assert sorted((r.index_key, r.type, r.index_id, r.node_id, r.ref_id) for r in rows) == [
        ("ix", "vector_store", "ix", "n1", "n1"), ("ix", "vector_store", "ix", "n2", "n2"),
    ]


def test_stream_equals_batch(spark, data, tmp_path):
    schema = spark.read.parquet(f"{data}/pages.parquet").schema
    out = str(tmp_path / "out")
    stream = files.read_stream(spark, data, schema, "pages.parquet")
    files.append_stream(stream, out, page_documents, str(tmp_path / "ck")).awaitTermination()
    want = page_documents(spark.read.parquet(f"{data}/pages.parquet"))
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == sorted(map(tuple, want.collect()))

    seen = []
    events = files.read_stream(spark, data, spark.read.parquet(f"{data}/events.parquet").schema, "events.parquet")
    files.process_batches(
        events, lambda df, i: seen.append(df.select(F.sum(lb.above(F.col("value"), 50.0))).first()[0]), str(tmp_path / "ck2")
    ).awaitTermination()
    assert sum(seen) == spark.read.parquet(f"{data}/events.parquet").where("value > 50").count()


def test_tsv_columns_by_name(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("labels\tnote\tid\nNeutral\tx\t7\n")
    found = read_tsv(spark, str(tmp_path), T.StructType.fromDDL("id int, labels string"))
    assert [tuple(r) for r in found.collect()] == [(7, "Neutral")]
    with pytest.raises(AnalysisException):
        read_tsv(spark, str(tmp_path), T.StructType.fromDDL("id int, text string"))


def plain_rows(spark, path):
    read = spark.read.options(sep="\t", header=True, quote='"', escape='"', multiLine=True)
    return sorted(map(str, read.csv(path).collect()))


@pytest.mark.parametrize("size", ["37", "64", "1000", "100000"])
def test_delimited_rows_do_not_depend_on_byte_ranges(spark, tmp_path, size):
    rng = random.Random(int(size))
    cells = ["a", "", "x y", '"q"', '"two\nlines"', '"a ""b"" c"', '"""start"', '"tab\there"', 'in"side', '"\n\n"', '"end"""', "é", '"l1\n""l2""\n\nl4"']
    for name, end in (("a", "\n"), ("b", "\r\n")):
        lines = ["id\ttext\tnote"] + [
            f"{k}\t{rng.choice(cells)}\t{rng.choice(cells)}".replace("\n", end) for k in range(150)
        ]
        (tmp_path / f"{name}.tsv").write_bytes((end.join(lines) + end * rng.randint(0, 2)).encode())
    kept = {c: spark.conf.get(c, None) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        for name in "ab":
            got = read_delimited(spark, str(tmp_path / f"{name}.tsv"))
            assert got.columns == ["id", "text", "note"]
            assert sorted(map(str, got.collect())) == plain_rows(spark, str(tmp_path / f"{name}.tsv"))
        if size == "37":
            assert spark.read.option("lineSep", "\n").text(str(tmp_path / "a.tsv")).rdd.getNumPartitions() > 20
        assert read_delimited(spark, [str(tmp_path / "a.tsv"), str(tmp_path / "b.tsv")]).count() == 300
    finally:
        for c, value in kept.items():
            spark.conf.set(c, value) if value is not None else spark.conf.unset(c)


def test_files_need_one_header(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("a\tb\n1\t2\n")
    (tmp_path / "b.tsv").write_text("a\tc\n1\t2\n")
    with pytest.raises(ValueError, match="different headers"):
        read_delimited(spark, str(tmp_path))


def test_manifests_of_mixed_shapes(spark, tmp_path):
    text = {"__type__": "a", "__data__": json.dumps({"index_id": "i1", "nodes_dict": {"n1": "r1"}, "more": [1, {"x": 2}]})}
    plain = {"__type__": 5, "__data__": {"index_id": "i2", "nodes_dict": {"n2": "r2", "n3": None}}, "other": True}
    odd = {"__data__": "no json"}
    lines = [{"index_store/data": {"k1": text, "k2": plain, "k3": odd, "k4": {}}, "beside": 1}, {"nothing": 1}, [1], "x"]
    (tmp_path / "m.txt").write_text("\n".join([*map(json.dumps, lines), "{broken"]))
    rows = index_store.read_json_manifest(spark, str(tmp_path / "m.txt"), whole=False).collect()
    assert sorted(map(tuple, rows), key=str) == [
        ("k1", "a", "i1", "n1", "r1"), ("k2", "5", "i2", "n2", "r2"), ("k2", "5", "i2", "n3", None),
    ]


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    rows = spark.range(10)
    for number, part in ((0, "id < 4"), (1, "id >= 4"), (0, "id < 4")):
        files.merge_batch(rows.where(part), number, str(tmp_path / "t"))
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "t")).collect()) == list(range(10))


def test_a_stored_row_id_is_kept(spark, tmp_path):
    rows = spark.createDataFrame([(7, "a"), (9, "b")], "row_id bigint, text string")
    rows.write.parquet(str(tmp_path / "with"))
    rows.drop("row_id").write.parquet(str(tmp_path / "without"))
    assert sorted(r.row_id for r in read_with_row_id(spark, str(tmp_path / "with")).collect()) == [7, 9]
    made = [r.row_id for r in read_with_row_id(spark, str(tmp_path / "without")).collect()]
    assert len(set(made)) == 2 and all(isinstance(r, str) for r in made)


def test_roundtrip_does_not_join_the_terms(spark, data):
    plan = QUERIES["index_roundtrip"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "n_terms" in plan and "terms#" not in plan.replace("n_terms#", "")
