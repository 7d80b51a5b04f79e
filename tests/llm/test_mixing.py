import os

import pytest

from flowloom.llm.bpe import TOKENIZER
from flowloom.llm.mixing import mix

pytestmark = pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="no tokenizer file")
TARGETS = "mix_id string, source string, target_share double, max_repeats int, size_ratio double"


def documents(spark, rows, extra=""):
    return spark.createDataFrame([(i, t, s, "x") for i, (t, s) in enumerate(rows)], "doc_id bigint, text string, source string, key string")


def test_shares_repeats_and_report(spark):
    rows = [(f"word {i} " * (1 + i % 13), ["Web", "web ", "WEB"][i % 3]) for i in range(300)] + [("tiny text", "small-src")] * 10 + [(None, "web"), ("", "web"), ("  ", None), ("lost words", None)]
    targets = spark.createDataFrame([("m", "web", 0.6, 1, 0.5), ("m", "small_src", 0.4, 3, 0.5), ("n", "web", 1.0, 2, 1.5), ("n", "absent", 0.5, 2, 1.0)], TARGETS)
    chosen, report = mix(documents(spark, rows), targets)
    got = {(r["mix_id"], r["source"]): r for r in report.collect()}
    copies = chosen.collect()
    for (m, s), r in got.items():
        own = [c for c in copies if (c["mix_id"], c["source"]) == (m, s)]
        assert r["tokens"] == sum(c["n_tokens"] for c in own)
        assert len({(c["doc_id"], c["copy_no"]) for c in own}) == len(own)
        assert max([c["copy_no"] for c in own], default=0) == r["most_copies"] <= r["max_repeats"]
    web, small, double, absent = got["m", "web"], got["m", "small_src"], got["n", "web"], got["n", "absent"]
    assert abs(web["tokens"] - web["wanted_tokens"]) <= 40 and not web["capped"]
    assert small["capped"] and small["tokens"] == 3 * small["available"] and small["most_copies"] == 3
    assert abs(double["tokens"] - double["wanted_tokens"]) <= 40 and double["most_copies"] == 2
    assert absent["tokens"] == 0 and absent["capped"]
    assert abs(sum(r["share"] for k, r in got.items() if k[0] == "m") - 1) < 1e-5


def test_repeatable(spark):
    rows = [(f"text {i % 4}", "a") for i in range(50)]
    targets = spark.createDataFrame([("m", "a", 1.0, 1, 0.3)], TARGETS)
    one, two = ({(r["doc_id"], r["copy_no"]) for r in mix(documents(spark, rows).repartition(p), targets)[0].collect()} for p in (1, 6))
    assert one == two and 10 <= len(one) <= 20


def test_empty(spark):
    targets = spark.createDataFrame([("m", "a", 1.0, 1, 0.3)], TARGETS)
    chosen, report = mix(documents(spark, []), targets)
    assert chosen.count() == 0 and report.first()["tokens"] == 0
    chosen, report = mix(documents(spark, [("x", "a")]), targets.limit(0))
    assert chosen.count() == 0 and report.count() == 0
