import ipaddress

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from flowloom.functions import canon


def one(spark, column, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(column).collect()]


def test_host_spellings(spark):
    n = int(ipaddress.IPv4Address("10.1.48.121"))
    same = ["10.1.48.121", " 10.1.48.121\t", "010.001.048.121", "::ffff:10.1.48.121", "::FFFF:10.1.48.121", "10.1.48.121/32", " 10.1.48.121", "​10.1.48.121"]
    assert one(spark, canon.host_number("v"), same) == [n] * len(same)
    bad = [None, "", "  ", "10.1.48", "10.1.48.121.9", "256.1.1.1", "1.2.3.x", "-1.2.3.4", "10.1.48.121/24", "host"]
    assert one(spark, canon.host_number("v"), bad) == [None] * len(bad)


def test_hosts_that_link(spark):
    no = ["0.0.0.0", "255.255.255.255", "127.0.0.1", "127.9.9.9", "224.0.0.1", "239.255.255.250", None]
    yes = ["0.0.0.1", "126.255.255.255", "128.0.0.0", "223.255.255.255", "240.0.0.0"]
    assert one(spark, canon.linking_host("v"), no) == [None] * len(no)
    assert one(spark, canon.linking_host("v"), yes) == [int(ipaddress.IPv4Address(x)) for x in yes]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), min_size=1, max_size=20))
def test_dotted_round_trip(spark, numbers):
    text = [str(ipaddress.IPv4Address(n)) for n in numbers]
    assert one(spark, canon.host_number("v"), text) == numbers
    assert one(spark, canon.dotted(F.col("v")), numbers, "bigint") == text


def test_groups_words_splits(spark):
    g = "0123456789abcdef0123456789abcdef"
    same = [g, g.upper(), "{01234567-89AB-CDEF-0123-456789ABCDEF}", "0x" + g, f" {g} "]
    assert one(spark, canon.group_key("v"), same) == [g] * len(same)
    assert one(spark, canon.group_key("v"), [None, "", "  ", g[:-1], g + "0"]) == [None] * 5
    assert one(spark, canon.word_key("v"), ["Brute Force", "brute-force", "BRUTE_FORCE\t", " ", None]) == ["bruteforce"] * 3 + [None, None]
    assert one(spark, canon.split_name("v"), ["Train ", "training", "VAL", "valid", "validation", "testing", "test\t", "", None, "other"]) == ["train"] * 2 + ["val"] * 3 + ["test"] * 2 + [None] * 3
