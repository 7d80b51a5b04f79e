"""Splits, samples, hashes and keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowloom.functions import canon
from flowloom.functions.hashing import bucket, bucket_sql, digest, digest_sql, hash60, hash60_sql
from flowloom.operators import audit, splitting
from flowloom.operators.skew import ordinals
from flowloom.plans import pipelines
from flowloom.plans.registry import Registry, Tables
from flowloom.schema import SPLITS

Q = Registry()


def _case(b: str) -> str:
    return f"(CASE WHEN {b} < 7 THEN 'train' WHEN {b} = 7 THEN 'val' ELSE 'test' END)"


_PRINTED = ", ".join(f"coalesce(CAST({c} AS VARCHAR), '')" for c in ("IPV4_SRC_ADDR", "L4_SRC_PORT", "IPV4_DST_ADDR", "L4_DST_PORT", "PROTOCOL", "IN_BYTES", "OUT_BYTES", "TCP_FLAGS", "FLOW_DURATION_MILLISECONDS"))
_GROUP_SPLIT = _case(bucket_sql("flow_group_id", splitting.SPLIT_SEED, 10))


@Q("h1_fingerprint", f"SELECT source_row_id, md5(concat_ws('|', {_PRINTED})) AS fingerprint FROM full_splits")
def fingerprint(t: Tables) -> DataFrame:
    """A fingerprint of nine whole-number columns, whose text is the same everywhere; `h1_flow_fingerprint` has all columns."""
    cols = ("IPV4_SRC_ADDR", "L4_SRC_PORT", "IPV4_DST_ADDR", "L4_DST_PORT", "PROTOCOL", "IN_BYTES", "OUT_BYTES", "TCP_FLAGS", "FLOW_DURATION_MILLISECONDS")
    return t.full_splits.select("source_row_id", F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols])).alias("fingerprint"))


@Q("h1_flow_fingerprint")
def flow_fingerprint(t: Tables) -> DataFrame:
    """The fingerprint of all columns but the labels, as ingest stores it. Engines print doubles differently, so tests replace SQL."""
    return t.full_splits.select("source_row_id", pipelines.fingerprint().alias("fingerprint"))


@Q("h2_two_hashes", f"SELECT source_row_id, {hash60_sql('flow_group_id', 1)} AS h1, {hash60_sql('flow_group_id', 2)} AS h2 FROM full_splits")
def two_hashes(t: Tables) -> DataFrame:
    """Two independent integer hashes of a key."""
    g = F.col("flow_group_id")
    return t.full_splits.select("source_row_id", hash60(g, 1).alias("h1"), hash60(g, 2).alias("h2"))


@Q("h3_priority", f"SELECT source_row_id, {digest_sql('flow_group_id', 20260919)} AS priority FROM full_splits ORDER BY priority, source_row_id LIMIT 500")
def priority(t: Tables) -> DataFrame:
    """The 500 rows of least seeded priority: a bottom-k report."""
    d = t.full_splits.select("source_row_id", digest(F.col("flow_group_id"), 20260919).alias("priority"))
    return d.orderBy(F.col("priority").asc_nulls_last(), "source_row_id").limit(500)


@Q("h4_bucket_split", f"SELECT source_row_id, {_GROUP_SPLIT} AS split FROM full_splits WHERE flow_group_id IS NOT NULL")
def bucket_split(t: Tables) -> DataFrame:
    """The split of every row by the hash of its flow group."""
    return t.full_splits.where("flow_group_id IS NOT NULL").select("source_row_id", splitting.group_split(F.col("flow_group_id")).alias("split"))


@Q("h5_endpoint_bucket", f"SELECT IPV4_SRC_ADDR AS ip, {bucket_sql('IPV4_SRC_ADDR', splitting.HOLDOUT_SEED, 10)} AS bucket FROM full_splits WHERE IPV4_SRC_ADDR IS NOT NULL GROUP BY 1")
def endpoint_bucket(t: Tables) -> DataFrame:
    """The bucket of every source address."""
    d = t.full_splits.select(F.col("IPV4_SRC_ADDR").alias("ip")).where("ip IS NOT NULL").distinct()
    return d.select("ip", bucket(F.col("ip"), splitting.HOLDOUT_SEED, 10).alias("bucket"))


_ORDER_KEY = "concat_ws('|', flow_group_id, CAST(source_row_id AS VARCHAR))"


@Q("h6_order_hash", f"SELECT source_row_id, {digest_sql(_ORDER_KEY, splitting.PILOT_SEED)} AS h FROM full_splits")
def order_hash(t: Tables) -> DataFrame:
    """The seeded hash by which samples are ordered."""
    return t.full_splits.select("source_row_id", digest(F.concat_ws("|", "flow_group_id", F.col("source_row_id").cast("string")), splitting.PILOT_SEED).alias("h"))


@Q("h7_permutation_hash", f"SELECT source_row_id, {hash60_sql('source_row_id', 20260928)} AS h FROM full_splits")
def permutation_hash(t: Tables) -> DataFrame:
    """The hash by which destinations are permuted; ties go by row id."""
    return t.full_splits.select("source_row_id", hash60(F.col("source_row_id"), 20260928).alias("h"))


@Q("h8_endpoint_key", "SELECT source_row_id, concat_ws('|', Dataset, IPV4_DST_ADDR || ':' || CAST(L4_DST_PORT AS VARCHAR)) AS dst FROM full_splits")
def endpoint_key(t: Tables) -> DataFrame:
    """Endpoints as Dataset|ip:port."""
    return t.full_splits.select("source_row_id", F.concat_ws("|", "Dataset", F.concat("IPV4_DST_ADDR", F.lit(":"), F.col("L4_DST_PORT").cast("string"))).alias("dst"))


@Q("h9_row_ids", "SELECT source_row_id, row_number() OVER (ORDER BY source_row_id) AS row_id FROM full_splits")
def row_ids(t: Tables) -> DataFrame:
    """Dense 1-based ids in the order of the source's ids, from a range partition, not from one task."""
    d = ordinals(t.full_splits.select("source_row_id"), [], ["source_row_id"], "row_id")
    return d.withColumn("row_id", F.col("row_id") + 1)


@Q("h11_class_codes", "SELECT Attack, CAST(dense_rank() OVER (ORDER BY Attack) - 1 AS BIGINT) AS code FROM (SELECT DISTINCT Attack FROM full_splits WHERE Attack IS NOT NULL)")
def class_codes(t: Tables) -> DataFrame:
    """Codes of the sorted classes; the window runs over the distinct classes only."""
    d = t.full_splits.select("Attack").where("Attack IS NOT NULL").distinct()
    return d.withColumn("code", (F.dense_rank().over(Window.orderBy("Attack")) - 1).cast("bigint"))


@Q("h11_unknown_classes", "WITH flow SELECT Attack, count(*) AS n FROM flow WHERE split <> 'train' AND Attack IS NOT NULL AND Attack NOT IN (SELECT Attack FROM flow WHERE split = 'train' AND Attack IS NOT NULL) GROUP BY 1")
def unknown_classes(t: Tables) -> DataFrame:
    """Classes of held-out rows that train does not have: counted first, then anti-joined."""
    seen = t.flow.where("split = 'train' AND Attack IS NOT NULL").select("Attack").distinct()
    held = t.flow.where("split <> 'train' AND Attack IS NOT NULL").groupBy("Attack").agg(F.count(F.lit(1)).alias("n"))
    return held.join(seen, "Attack", "left_anti")


@Q("h12_binary_codes", "SELECT source_row_id, Label AS code, CASE Label WHEN 0 THEN 'Benign' WHEN 1 THEN 'Attack' END AS name FROM full_splits WHERE Label IN (0, 1)")
def binary_codes(t: Tables) -> DataFrame:
    """Binary codes in their fixed order."""
    name = F.when(F.col("Label") == 0, "Benign").when(F.col("Label") == 1, "Attack")
    return t.full_splits.where(F.col("Label").isin(0, 1)).select("source_row_id", F.col("Label").alias("code"), name.alias("name"))


_PILOT = {"train": 40, "val": 10, "test": 20}  # caps in proportion to the published ones, for the test tables' size


@Q("t1_pilot_topk", f"""WITH flow SELECT source_row_id, split, Attack FROM flow WHERE split IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY split, Attack ORDER BY {digest_sql(_ORDER_KEY, splitting.PILOT_SEED)}, source_row_id) <= CASE split WHEN 'train' THEN 40 WHEN 'val' THEN 10 ELSE 20 END""")
def pilot_topk(t: Tables) -> DataFrame:
    """A small bounded sample by split and class; `t1_pilot_sample` has the published caps."""
    return splitting.pilot_sample(t.flow.select("source_row_id", "flow_group_id", "split", "Attack"), _PILOT).select("source_row_id", "split", "Attack")


@Q("t1_pilot_sample", f"""WITH flow SELECT source_row_id, split, Attack FROM flow WHERE split IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY split, Attack ORDER BY {digest_sql(_ORDER_KEY, splitting.PILOT_SEED)}, source_row_id) <= CASE split {" ".join(f"WHEN '{s}' THEN {n}" for s, n in splitting.PILOT_CAPS.items())} END""")
def pilot_sample(t: Tables) -> DataFrame:
    """The pilot sample by split and class under the published caps."""
    return splitting.pilot_sample(t.flow.select("source_row_id", "flow_group_id", "split", "Attack"), splitting.PILOT_CAPS).select("source_row_id", "split", "Attack")


@Q("t2_bottom_k", f"""
WITH g AS (SELECT flow_group_id AS g, min(source_row_id) AS row_id, min(Attack) AS Attack FROM full_splits WHERE flow_group_id IS NOT NULL GROUP BY 1 HAVING min(Attack) = max(Attack))
SELECT row_id, Attack FROM g ORDER BY {digest_sql('g', 20260919)}, g LIMIT 1000""")
def bottom_k(t: Tables) -> DataFrame:
    """A sample of 1000 groups without label conflict by least priority, each by its first row."""
    g = t.full_splits.where("flow_group_id IS NOT NULL").groupBy(F.col("flow_group_id").alias("g")).agg(F.min("source_row_id").alias("row_id"), F.min("Attack").alias("Attack"), F.max("Attack").alias("hi")).where("Attack = hi")
    return g.orderBy(digest(F.col("g"), 20260919), "g").limit(1000).select("row_id", "Attack")


@Q("j8_sample_rows", f"""
WITH g AS (SELECT flow_group_id AS g, min(source_row_id) AS row_id, min(Attack) AS Attack FROM full_splits WHERE flow_group_id IS NOT NULL GROUP BY 1 HAVING min(Attack) = max(Attack)),
k AS (SELECT row_id FROM g ORDER BY {digest_sql('g', 20260919)}, g LIMIT 1000)
SELECT source_row_id, IN_BYTES, OUT_BYTES, Dataset FROM full_splits WHERE source_row_id IN (SELECT row_id FROM k)""")
def sample_rows(t: Tables) -> DataFrame:
    """The source rows of that sample: a semi-join with its 1000 ids."""
    ids = bottom_k(t).select(F.col("row_id").alias("source_row_id"))
    return t.full_splits.join(F.broadcast(ids), "source_row_id", "left_semi").select("source_row_id", "IN_BYTES", "OUT_BYTES", "Dataset")


@Q("t5_systematic_sample", """
WITH r AS (SELECT source_row_id, row_number() OVER (ORDER BY source_row_id) - 1 AS i, count(*) OVER () AS n FROM full_splits),
k AS (SELECT CASE WHEN j = 99 THEN (SELECT max(n) FROM r) - 1 ELSE CAST(floor(j * (((SELECT max(n) FROM r) - 1)::DOUBLE / 99)) AS BIGINT) END AS i FROM range(100) x(j))
SELECT source_row_id FROM r WHERE i IN (SELECT i FROM k)""")
def systematic_sample(t: Tables) -> DataFrame:
    """100 evenly spaced rows in the order of their ids."""
    rows = ordinals(t.full_splits.select("source_row_id"), [], ["source_row_id"], "i")
    return splitting.evenly_spaced(rows, "i", t.full_splits.count(), 100).select("source_row_id")


@Q("t6_sorted_rows", "SELECT source_row_id, Attack FROM full_splits ORDER BY source_row_id")
def sorted_rows(t: Tables) -> DataFrame:
    """Rows sorted by id."""
    return t.full_splits.select("source_row_id", "Attack").orderBy("source_row_id")


@Q("t7_ordered_output", "SELECT Dataset, Attack, count(*) AS n FROM full_splits GROUP BY ALL ORDER BY n DESC, Dataset, Attack")
def ordered_output(t: Tables) -> DataFrame:
    """Counts in a stable order for output."""
    n = t.full_splits.groupBy("Dataset", "Attack").agg(audit.n_rows().alias("n"))
    return n.orderBy(F.col("n").desc(), F.col("Dataset").asc_nulls_last(), F.col("Attack").asc_nulls_last())


_T11 = """
WITH r AS (SELECT source_row_id, Attack, (row_number() OVER (PARTITION BY Attack ORDER BY {h}, source_row_id) - 0.5) / count(*) OVER (PARTITION BY Attack) AS pos FROM full_splits)
SELECT source_row_id, CASE WHEN pos <= 0.7 + 1e-12 THEN 'train' WHEN pos <= 0.8 + 1e-12 THEN 'val' ELSE 'test' END AS part FROM r"""


@Q("t11_stratified_splits", _T11.replace("{h}", digest_sql("source_row_id", 20260919)))
def stratified(t: Tables) -> DataFrame:
    """Each class split 70/10/20 by the rank of its rows' hashes."""
    d = t.full_splits.select("source_row_id", "Attack", digest(F.col("source_row_id"), 20260919).alias("h"))
    return splitting.stratified_splits(d, "Attack", ["h", "source_row_id"], [("train", 0.7), ("val", 0.1), ("test", 0.2)]).select("source_row_id", "part")


@Q("t12_batch_cap", f"WITH flow SELECT source_row_id, CAST((rn - 1) // 256 AS BIGINT) AS batch FROM (SELECT source_row_id, row_number() OVER (ORDER BY {digest_sql('source_row_id', 12)}, source_row_id) AS rn FROM flow WHERE split = 'train') WHERE rn <= 4 * 256")
def batch_cap(t: Tables) -> DataFrame:
    """The first four batches of 256 rows of an epoch's shuffled order: a top-k, so no full sort."""
    d = t.flow.where("split = 'train'").select("source_row_id").orderBy(digest(F.col("source_row_id"), 12), "source_row_id").limit(4 * 256)
    rn = F.row_number().over(Window.orderBy(digest(F.col("source_row_id"), 12), "source_row_id"))  # over the 1024 rows left
    return d.select("source_row_id", F.floor((rn - 1) / 256).alias("batch"))


@Q("t13_epoch_shuffle", f"WITH flow SELECT source_row_id, CAST(row_number() OVER (ORDER BY {digest_sql('source_row_id', 13)}, source_row_id) - 1 AS BIGINT) AS place FROM flow WHERE split = 'train'")
def epoch_shuffle(t: Tables) -> DataFrame:
    """The place of each training row in the seeded order of an epoch."""
    d = t.flow.where("split = 'train'").select("source_row_id", digest(F.col("source_row_id"), 13).alias("h"))
    return ordinals(d, [], ["h", "source_row_id"], "place").select("source_row_id", "place")


_S, _D = bucket_sql("IPV4_SRC_ADDR", splitting.HOLDOUT_SEED, 10), bucket_sql("IPV4_DST_ADDR", splitting.HOLDOUT_SEED, 10)
_HELD = f"held AS (SELECT source_row_id, Attack, Label, {_case(_S)} AS split FROM full_splits WHERE IPV4_SRC_ADDR IS NOT NULL AND IPV4_DST_ADDR IS NOT NULL AND {_case(_S)} = {_case(_D)})"


def held(t: Tables) -> DataFrame:
    """Rows whose two addresses fall in one split; rows without an address are left out."""
    known = t.full_splits.where("IPV4_SRC_ADDR IS NOT NULL AND IPV4_DST_ADDR IS NOT NULL")
    return splitting.endpoint_holdout(known, "IPV4_SRC_ADDR", "IPV4_DST_ADDR").select("source_row_id", "Attack", "Label", "split")


@Q("p16_same_label", f"WITH {_HELD} SELECT source_row_id, split FROM held")
def same_label(t: Tables) -> DataFrame:
    """Rows kept by the endpoint-disjoint split."""
    return held(t).select("source_row_id", "split")


@Q("g10_endpoint_holdout", f"WITH {_HELD} SELECT split, Attack, count(*) AS n FROM held GROUP BY ALL")
def holdout_counts(t: Tables) -> DataFrame:
    """Rows of the endpoint-disjoint split by split and class."""
    return held(t).groupBy("split", "Attack").agg(audit.n_rows().alias("n"))


@Q("a14_retained", f"WITH {_HELD} SELECT (SELECT count(*) FROM held) AS kept, (SELECT count(*) FROM full_splits) AS total, round((SELECT count(*) FROM held) / (SELECT count(*) FROM full_splits), 9) AS retained")
def retained(t: Tables) -> DataFrame:
    """How much of the table the endpoint-disjoint split retains."""
    kept = held(t).agg(audit.n_rows().alias("kept"))
    total = t.full_splits.count()
    return kept.select("kept", F.lit(total).cast("bigint").alias("total"), audit.ratio(F.col("kept"), F.lit(total)).alias("retained"))


@Q("a37_eligibility", f"""
WITH {_HELD}, grid AS (SELECT s.split, c.Attack FROM split_shares s, (SELECT DISTINCT Attack FROM held WHERE Attack IS NOT NULL) c),
n AS (SELECT grid.split, grid.Attack, count(held.source_row_id) AS n FROM grid LEFT JOIN held ON held.split = grid.split AND held.Attack = grid.Attack GROUP BY ALL)
SELECT Attack, min(n) AS min_rows, bool_and(n >= 30) AS eligible FROM n GROUP BY 1""")
def eligibility(t: Tables) -> DataFrame:
    """Classes with at least 30 rows in every split."""
    return audit.eligibility(held(t), SPLITS, "Attack", 30)


@Q("p15_split_case", f"SELECT bucket, {_case('bucket')} AS split FROM (SELECT range AS bucket FROM range(10))")
def split_case(t: Tables) -> DataFrame:
    """The split of each bucket."""
    return t.spark.range(10).select(F.col("id").alias("bucket"), splitting.split_of_bucket(F.col("id")).alias("split"))


@Q("f6_hex", "SELECT source_row_id, lpad(lower(to_hex(source_row_id)), 16, '0') AS hex FROM full_splits")
def hexed(t: Tables) -> DataFrame:
    """Ids as 16 hex digits."""
    return t.full_splits.select("source_row_id", F.lpad(F.lower(F.hex("source_row_id")), 16, "0").alias("hex"))


@Q("f0_canonical_flow", f"SELECT source_row_id, {canon.host_number_sql('IPV4_SRC_ADDR')} AS src, {canon.group_key_sql('flow_group_id')} AS flow_group, {canon.split_name_sql('split')} AS split, {canon.word_key_sql('Attack')} AS attack FROM full_splits")
def canonical(t: Tables) -> DataFrame:
    """Canonical spellings of addresses, groups, splits and classes."""
    return t.full_splits.select("source_row_id", canon.host_number("IPV4_SRC_ADDR").alias("src"), canon.group_key("flow_group_id").alias("flow_group"), canon.split_name("split").alias("split"), canon.word_key("Attack").alias("attack"))


QUERIES, SQL = Q.queries, Q.sql
