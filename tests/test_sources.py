from datetime import date

import pytest
from inline import make_sources, random_rows
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.operators.events import FactsOptions, facts
from cohortlens.operators.joins import broadcast_checked, join_salted
from cohortlens.plans import datasets as ds
from cohortlens.plans.periods import HOLDOUT_2025, TEST_2025, TRAIN_2025, WEEK_2025, Week
from cohortlens.sources import files
from cohortlens.sources.schema import (
    DATASET_SCHEMA,
    coerce_dataset,
    ensure_columns,
    require_columns,
    split_sets,
    validate,
)
from cohortlens.sources.staging import checkpoint_dir, drop_staged, read_facts, settle, stage_table, staged_version, write_facts
from cohortlens.sources.tables import Rules, read_sources


@pytest.fixture(scope="module")
def dataset(spark):
    return ds.train_test_dataset(make_sources(spark, **random_rows(11)), [TRAIN_2025, TEST_2025]).persist()


def by_key(df):
    return {(r["set"], r["user_id"]): tuple(r[c] for c in ds.DATASET_COLUMNS) for r in df.collect()}


@pytest.mark.parametrize("fmt", ["csv", "parquet", "orc"])
def test_dataset_round_trip(spark, dataset, tmp_path, fmt):
    path = str(tmp_path / fmt)
    files.write_dataset(dataset, path, fmt)
    files.write_dataset(dataset, path, fmt)  # a rerun replaces the files
    again = files.read_dataset(spark, path, fmt)
    assert by_key(again) == by_key(dataset)
    if fmt == "csv":
        assert [f.dataType for f in again.schema] == [f.dataType for f in DATASET_SCHEMA]


def test_ordered_export(spark, dataset, tmp_path):
    path = tmp_path / "ordered"
    files.write_dataset(dataset, str(path), "csv", order_by=["set", "cutoff_date", "user_id"])
    keys = []
    for part in sorted(path.glob("part-*")):
        for line in part.read_text().splitlines()[1:]:
            keys.append(tuple(line.split(",")[:3]))
    assert keys == sorted(keys) and len(keys) == dataset.count()


def test_csv_of_weekly_rows_with_other_columns(spark, tmp_path):
    src = make_sources(spark, **random_rows(12, users=30))
    weekly = ds.weekly_dataset(src, WEEK_2025, km_mode="cast").withColumn("note", F.lit("x"))
    path = str(tmp_path / "weekly")
    files.write_dataset(weekly, path, "csv")
    again = files.read_dataset(spark, path, "csv")
    assert again.schema["n_qleads_7d"].dataType == T.LongType()
    assert again.schema["note"].dataType == T.StringType()
    extra = T.StructType([T.StructField("note", T.IntegerType())])
    assert files.read_dataset(spark, path, "csv", extra).schema["note"].dataType == T.IntegerType()


def test_csv_numbers_with_fractions(spark, tmp_path):
    path = tmp_path / "exported.csv"
    path.write_text("set,cutoff_date,user_id,recency_last_qlead,n_qleads_90d\ntest,2025-07-01,a,12.0,3\ntest,2025-07-01,b,,0\n")
    df = files.read_dataset(spark, str(path), "csv")
    assert [tuple(r)[2:] for r in df.orderBy("user_id").collect()] == [("a", 12, 3), ("b", None, 0)]
    path.write_text("user_id,n_qleads_90d\na,many\n")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        files.read_dataset(spark, str(path), "csv").collect()


def test_missing_columns_are_named(dataset):
    with pytest.raises(ValueError, match="target_30d"):
        require_columns(dataset.drop("target_30d"))
    with pytest.raises(ValueError, match="n_bookings_90d"):
        coerce_dataset(dataset.drop("n_bookings_90d"))


def test_rows_without_a_label_fail(dataset):
    assert coerce_dataset(dataset).schema["target_30d"].dataType == T.IntegerType()
    assert by_key(coerce_dataset(dataset)) == by_key(dataset)
    unlabelled = dataset.withColumn("target_30d", F.lit(None).cast("int"))
    with pytest.raises(Exception, match="target_30d is NULL"):
        coerce_dataset(unlabelled).collect()


def test_ensure_columns_adds_nulls(dataset):
    row = ensure_columns(dataset.drop("reg_km_log1p"), ["reg_km_log1p", "user_id"]).first()
    assert row["reg_km_log1p"] is None and row["user_id"] is not None


def test_split_accepts_any_case_and_rejects_empty(dataset):
    mixed = dataset.withColumn("set", F.when(F.col("set") == "train", "Train").otherwise("TEST"))
    train, test = split_sets(mixed)
    assert train.count() + test.count() == dataset.count()
    with pytest.raises(ValueError, match="empty"):
        split_sets(dataset.filter("set = 'train'"))


def test_read_sources_renames_warehouse_columns(spark, tmp_path):
    src = make_sources(spark, **random_rows(13))
    back = {
        "reservations": {"account": "account__c", "opportunity": "opportunity__c", "paymentdate": "paymentdate__c",
                         "status": "status__c", "country": "country__c"},
        "opportunities": {"country": "country__c", "recordtypename": "recordtypename__c"},
    }
    names = {}
    for name, df in src.__dict__.items():
        names[name] = str(tmp_path / name)
        df.withColumnsRenamed(back.get(name, {})).write.parquet(names[name])
    loaded = read_sources(spark, names, fmt="parquet")
    want = by_key(ds.train_test_dataset(src, [TRAIN_2025]))
    assert by_key(ds.train_test_dataset(loaded, [TRAIN_2025])) == want


def test_stage_table_is_rebuilt_and_joins_without_shuffle(spark, dataset):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        a = stage_table(dataset, "staged_a", buckets=4)
        a = stage_table(dataset, "staged_a", buckets=4)
        b = stage_table(dataset.groupBy("user_id").agg(F.max("target_30d").alias("any")), "staged_b", buckets=4)
        assert a.count() == dataset.count()
        joined = a.join(b, "user_id", "left")
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == dataset.count()
        assert stage_table(dataset, "staged_plain", key=None).count() == dataset.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        for t in ("staged_a", "staged_b", "staged_plain"):
            drop_staged(spark, t)


def test_buckets_follow_the_rows_and_not_the_estimate_of_a_join(spark):
    src = make_sources(spark, **random_rows(11))
    joined = ds.train_test_dataset(src, [TRAIN_2025, TEST_2025])
    for _ in range(3):  # the optimizer multiplies the sizes of both sides
        joined = joined.join(joined.select("set", "cutoff_date", "user_id"), ["set", "cutoff_date", "user_id"])
    try:
        for buckets in (None, 3):
            staged = stage_table(joined, "staged_joined", buckets=buckets)
            stored = spark.read.table(staged_version(spark, "staged_joined"))
            about = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE EXTENDED {staged_version(spark, 'staged_joined')}").collect()}
            assert about["Num Buckets"] == str(buckets or 1) and len(stored.inputFiles()) <= (buckets or 1)
            assert staged.count() == joined.count() > 0
    finally:
        drop_staged(spark, "staged_joined")


def test_staging_a_table_onto_itself_keeps_its_rows(spark, dataset):
    try:
        stage_table(dataset, "staged_self")
        again = stage_table(spark.table("staged_self").filter("n_qleads_90d >= 0"), "staged_self")
        assert again.count() == dataset.count() > 0
        with pytest.raises(Exception, match="gone wrong"):
            failing = spark.table("staged_self").withColumn("user_id", F.raise_error(F.lit("gone wrong")).cast("string"))
            stage_table(failing, "staged_self", key=None)
        assert spark.table("staged_self").count() == dataset.count()
    finally:
        drop_staged(spark, "staged_self")


def test_a_run_that_fails_before_the_swap_leaves_the_old_rows(spark, dataset, monkeypatch):
    from cohortlens.sources import staging

    try:
        stage_table(dataset, "staged_swap")
        first = staged_version(spark, "staged_swap")
        with monkeypatch.context() as patch:
            patch.setattr(staging, "_swap", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
            with pytest.raises(RuntimeError, match="killed"):
                stage_table(dataset.limit(1), "staged_swap")
        assert staged_version(spark, "staged_swap") == first
        assert spark.table("staged_swap").count() == dataset.count()
        reader = spark.table("staged_swap")
        stage_table(dataset.limit(2), "staged_swap")
        assert spark.table("staged_swap").count() == 2
        assert reader.count() == dataset.count()  # planned before the swap, its version still stands
        stage_table(dataset.limit(3), "staged_swap")
        assert spark.table("staged_swap").count() == 3
        assert len(staging._versions(spark, "staged_swap")) == 2 and not spark.catalog.tableExists(first)
    finally:
        drop_staged(spark, "staged_swap")


def test_a_plain_table_becomes_a_version(spark, dataset):
    try:
        dataset.limit(4).write.saveAsTable("staged_plain_before")
        assert stage_table(spark.table("staged_plain_before").limit(2), "staged_plain_before", key=None).count() == 2
    finally:
        drop_staged(spark, "staged_plain_before")


def test_csv_rows_that_do_not_fit_are_kept_aside(spark, tmp_path):
    path = tmp_path / "broken.csv"
    path.write_text(
        "set,cutoff_date,user_id,n_qleads_90d,note\n"
        "test,2025-07-01,a,3,fine\ntest,2025-07-01,b,many,x\ntest,2025-07-01,c\ntest,2025-07-01,d,1,x,y\n"
        "test,soon,e,1.0,\ntest,2025-07-01,f,,\"a, b\"\ntest,never,g,none,z\n"
    )
    rows, rejected = files.read_csv_checked(spark, str(path))
    assert [tuple(r)[2:] for r in rows.orderBy("user_id").collect()] == [("a", 3, "fine"), ("f", None, "a, b")]
    assert rows.schema["cutoff_date"].dataType == T.DateType()
    assert sorted((r.text, r.reasons) for r in rejected.collect()) == [
        ("test,2025-07-01,b,many,x", ["n_qleads_90d: many"]), ("test,2025-07-01,c", ["columns"]), ("test,2025-07-01,d,1,x,y", ["columns"]),
        ("test,never,g,none,z", ["cutoff_date: never", "n_qleads_90d: none"]), ("test,soon,e,1.0,", ["cutoff_date: soon"]),
    ]
    good, none = files.read_csv_checked(spark, str(path), T.StructType([T.StructField("note", T.StringType())]))
    assert good.count() == 2 and none.count() == 5


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_sorted_files_have_their_rows_and_order(spark, tmp_path, fmt):
    df = spark.range(1003).selectExpr("cast(pmod(hash(id), 400) AS int) AS k", "id AS v").withColumn("k", F.when(F.col("v") % 100 != 7, F.col("k")))
    files.write_sorted(df.repartition(9), str(tmp_path / "out"), ["k", "v"], 250, fmt)
    read = spark.read.option("header", True).format(fmt).load(str(tmp_path / "out"))
    folders = sorted(p.name for p in (tmp_path / "out").glob("file=*"))
    assert folders == [f"file={i:07d}" for i in range(5)]
    assert all(len(list((tmp_path / "out" / f).glob("part-*"))) == 1 for f in folders)
    got = [(r.k, int(r.v)) for f in folders for r in spark.read.option("header", True).format(fmt).load(str(tmp_path / "out" / f)).collect()]
    want = sorted(((r.k, r.v) for r in df.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert [(None if k is None else int(k), v) for k, v in got] == want and read.count() == 1003
    with pytest.raises(ValueError):
        files.write_sorted(df, str(tmp_path / "none"), [])


def test_validation_lists_what_a_run_refuses(spark, dataset):
    assert validate(dataset).count() == 0
    broken = dataset.filter("set = 'train'").withColumns({
        "user_id": F.when(F.col("user_id") != "u1", F.col("user_id")), "n_qleads_90d": F.lit("many"),
        "target_30d": F.when(F.col("user_id") == "u2", 2).otherwise(F.lit(None)).cast("int"),
    }).drop("n_bookings_90d", "recency_last_qlead")
    n = broken.count()
    one, two = (broken.filter(x).count() for x in ("user_id IS NULL", "user_id = 'u2'"))
    got = {(r.rule, r.column): r["rows"] for r in validate(broken).collect()}
    want = {("empty set", "test"): 0, ("missing column", "n_bookings_90d"): n, ("missing column", "recency_last_qlead"): n,
            ("not a number", "n_qleads_90d"): n, ("no key", "user_id"): one, ("bad label", "target_30d"): two, ("no label", "target_30d"): n - two}
    assert got == {k: v for k, v in want.items() if v or k[0] == "empty set"}
    assert {(r.rule, r.column): r["rows"] for r in validate(dataset.limit(0)).collect()} == {("empty set", "train"): 0, ("empty set", "test"): 0}
    assert {r.column for r in validate(dataset.withColumn("set", F.lit("other"))).collect()} == {"train", "test", "set"}


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("facts") / "facts")
    src = make_sources(spark, **random_rows(15, users=30))
    built = FactsOptions(Rules(), (None, None), (None, None), "cast", True)
    write_facts(facts(src, built.rules, *(built.feature_span, built.label_span), km_mode="cast", km_in_key=True), path, built)
    return src, path


@pytest.mark.parametrize("fanout", [True, False])
def test_datasets_from_stored_facts(spark, stored, fanout):
    src, path = stored
    q3 = read_facts(spark, path, HOLDOUT_2025.period_start, HOLDOUT_2025.period_end_excl)
    want = by_key(ds.holdout_dataset(src, HOLDOUT_2025))
    assert want and by_key(ds.holdout_dataset(src, HOLDOUT_2025, events=q3)) == want
    week = Week(date(2025, 2, 1), date(2025, 5, 31))
    # Unlike the counts of pairs, the plain ones need no events from the horizon on.
    events = read_facts(spark, path) if fanout else read_facts(spark, path, None, week.horizon_end)
    direct = ds.weekly_dataset(src, week, fanout=fanout)
    again = ds.weekly_dataset(src, week, fanout=fanout, events=events)
    assert sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, direct.collect()), key=str)


def test_facts_that_do_not_suit_fail(spark, stored):
    src, path = stored
    week = Week(date(2025, 2, 1), date(2025, 5, 31))
    whole, q3 = read_facts(spark, path), read_facts(spark, path, date(2025, 7, 1), date(2025, 9, 1))
    for build in (
        lambda: ds.train_test_dataset(src, [TRAIN_2025], events=whole),  # other odometer options
        lambda: ds.holdout_dataset(src, HOLDOUT_2025, events=q3),  # too few days
        lambda: ds.holdout_dataset(src, HOLDOUT_2025, Rules(lead="true"), events=whole),
        lambda: ds.weekly_dataset(src, week, fanout=True, events=read_facts(spark, path, None, week.horizon_end)),
    ):
        with pytest.raises(Exception, match="do not suit"):
            build().collect()
    with pytest.raises(ValueError, match="no record"):
        ds.holdout_dataset(src, HOLDOUT_2025, events=whole.drop("built"))


def test_reading_facts_prunes_months(spark, tmp_path):
    path = str(tmp_path / "facts")
    src = make_sources(spark, **random_rows(16))
    built = FactsOptions(Rules(), (None, None), (None, None))
    write_facts(facts(src, built.rules, (None, None), (None, None)), path, built)
    q2 = read_facts(spark, path, date(2025, 4, 1), date(2025, 7, 1))
    plan = q2._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "month" in plan[plan.index("PartitionFilters"):]
    months = {f.split("month=")[1][:7] for f in q2.inputFiles()}
    assert q2.count() > 0
    days = [r[0] for r in q2.select("event_date").collect()]
    assert min(days) >= date(2025, 4, 1) and max(days) < date(2025, 7, 1) and months


def test_settle_uses_the_session_checkpoint_folder(spark, dataset):
    assert spark.sparkContext.getConf().get("spark.checkpoint.dir") == checkpoint_dir(spark)
    settled = settle(dataset)
    assert all(checkpoint_dir(spark) in f for f in settled.inputFiles())
    assert by_key(settled) == by_key(dataset)


@pytest.mark.parametrize("hot_rows", [5, 10_000])
def test_salted_semi_join_equals_semi_join(spark, hot_rows):
    facts = spark.range(300).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 50 = 1 THEN NULL ELSE concat('u', id % 40) END AS k", "id AS v"
    )
    keys = spark.createDataFrame([("hot",), ("hot",), ("u1",), ("u7",), ("none",), (None,)], "k string")
    want = sorted(r["v"] for r in facts.join(keys, "k", "left_semi").collect())
    got = join_salted(facts, keys.distinct(), "k", ["v"], how="left_semi", hot_rows=hot_rows, salts=7)
    inner = join_salted(facts, keys.distinct(), "k", ["v"], hot_rows=hot_rows, salts=7)
    assert sorted(r["v"] for r in inner.collect()) == want
    assert got.columns == ["k", "v"]
    assert sorted(r["v"] for r in got.collect()) == want


@pytest.mark.parametrize("how", ["left_semi", "inner"])
def test_salting_splits_a_hot_key(spark, how):
    facts = spark.range(2000).selectExpr("CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('u', id) END AS k", "id AS v")
    keys = facts.select("k").distinct()
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = join_salted(facts, keys, "k", ["v"], how=how, hot_rows=100, salts=16)
        sizes = [r["n"] for r in joined.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(sizes) == 2000 and max(sizes) < 800


def test_broadcast_only_below_the_limit(spark):
    df = spark.range(50).withColumn("x", F.lit(1))
    assert broadcast_checked(df, 49) is df and not df.storageLevel.useMemory
    hinted = broadcast_checked(df, 50)
    assert "broadcast" in hinted._jdf.queryExecution().analyzed().toString()
    assert df.storageLevel.useMemory
    assert broadcast_checked(df, 49) is df and df.storageLevel.useMemory  # cached before, stays so
    df.unpersist()
