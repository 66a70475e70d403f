from seqrec.plans.lineage import materialize


def test_tables_in_the_shared_folder_are_part_files_only(spark):
    """No checksum or marker beside them: each costs a process of the driver's or an executor's size."""
    jvm = spark.sparkContext._jvm
    out = materialize(spark.range(0, 1000, 1, 3), "plain")
    path = jvm.org.apache.hadoop.fs.Path(out._seqrec_path)
    raw = jvm.org.apache.hadoop.fs.RawLocalFileSystem()
    raw.initialize(jvm.java.net.URI("file:///"), spark.sparkContext._jsc.hadoopConfiguration())
    names = sorted(s.getPath().getName() for s in raw.listStatus(path))
    assert len(names) == 3 and all(n.startswith("part-") and n.endswith(".parquet") for n in names)
    assert out.count() == 1000 and out.distinct().count() == 1000


def test_exploded_tables_are_not_broadcast_by_their_size_before(spark):
    """Each class is posted 32 times: Spark's own estimate of the posts is far under what they are."""
    from seqrec.llm import near_dedup as ND

    name = "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(name)
    spark.conf.set(name, "10m")
    try:
        docs = spark.createDataFrame([(i, " ".join(f"w{(i * i + j) % 97}" for j in range(12))) for i in range(300)], "id long, text string")
        classes = materialize(ND.signatures(docs, 3).where("digest IS NOT NULL").selectExpr("id AS cls", "sig"), "classes")
        before = len(_plans(spark))
        assert ND.candidate_links(classes, 60).count() >= 0
        assert not [p for p in _plans(spark)[before:] if "BroadcastHashJoin" in p or "BroadcastExchange" in p]
    finally:
        spark.conf.set(name, old)


def _plans(spark):
    """Physical plans of the session's executions, in order."""
    store = spark._jsparkSession.sharedState().statusStore()
    runs = store.executionsList()
    return [runs.apply(i).physicalPlanDescription() for i in range(runs.size())]


def test_shuffle_files_of_a_written_table_are_deleted(spark):
    shuffles = lambda: spark.sparkContext._jsc.sc().env().mapOutputTracker().shuffleStatuses().size()
    table = spark.range(5000).selectExpr("id % 1000 AS k").repartition(3, "k").groupBy("k").count()
    before = shuffles()
    out = materialize(table, "counts")
    assert shuffles() <= before and out.count() == 1000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
