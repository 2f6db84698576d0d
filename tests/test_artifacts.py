from spoorline.sources import sinks


def test_found_digests_are_not_sent_through_the_driver(spark):
    files = spark.createDataFrame([("a", "1"), ("b", "2")], "file string, file_sha256 string")
    pins = spark.createDataFrame([("p", {"a": "1", "b": "9", "c": "3"})], "pin_id string, files map<string,string>")
    found = sinks.artifact_verify(files, pins)
    assert sorted(tuple(r) for r in found.collect()) == [("p", "a", "ok"), ("p", "b", "mismatch"), ("p", "c", "missing")]
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
