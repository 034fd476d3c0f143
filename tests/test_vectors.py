import hashlib

import numpy as np
from pyspark.sql import functions as F

from tessera.functions import vectors as V


def test_query_vector_slots_and_length(spark):
    t = "What was net income of Acme Inc. in 2023?"
    got = spark.range(1).select(V.query_vector(F.lit(t)).alias("v")).first()["v"]
    want = np.zeros(64)
    want[:9] = [0.1, 0.2, 0.1, 9 / 200, 1, 1, 1, 0, 1]
    for name in ("net income", "2023", "Acme Inc"):
        want[9 + int(hashlib.sha1(name.encode()).hexdigest(), 16) % 55] = 1
    assert np.allclose(got, want / np.linalg.norm(want))


def test_query_features(spark):
    got = spark.range(1).select(V.query_features(F.lit("How much did revenue increase between 2021 and 2022?")).alias("v")).first()["v"]
    assert got == [0.4, 0.1, 0.0, 9 / 200, 1.0, 1.0, 1.0]


def test_node_features(spark):
    nodes = spark.createDataFrame([("c", "chunk"), ("metric::m", "metric"), ("company::x", "company")], "node_id string, node_type string")
    edges = spark.createDataFrame([("c", "metric::m")], "src string, dst string")
    vec = spark.createDataFrame([("c", [0.5, 1.0])], "node_id string, vector array<float>")
    score = spark.createDataFrame([("c", 2.0)], "node_id string, score double")
    got = {r["node_id"]: r["features"] for r in V.node_features(nodes, edges, vec, score, 2).collect()}
    assert np.allclose(got["c"], [0.5, 1, 2, 1, 0, 0, 0, 0, np.log(2)])
    assert np.allclose(got["metric::m"], [0, 0, 0, 0, 1, 0, 0, 0, np.log(2)]) and np.allclose(got["company::x"], [0, 0, 0, 1, 0, 0, 0, 0, 0])
