import random

from pyspark.sql import functions as F

from hostlens.operators import corpus
from hostlens.operators.dedup import last_wins
from hostlens.operators.joins import measured
from hostlens.schemas import CLEAN, NORMALIZED, URL_DATASET, align


def rows_of(spark, data):
    """(value, label, day, type[, source]) -> normalized rows."""
    full = [(v, lab, s[0] if s else "s", d, t, "", None, "") for v, lab, d, t, *s in data]
    return spark.createDataFrame(full, NORMALIZED)


def random_rows(n, seed):
    rnd = random.Random(seed)
    hosts = [f"h{i}.example.com" for i in range(12)]
    out = []
    for _ in range(n):
        host = hosts[0] if rnd.random() < 0.4 else rnd.choice(hosts)
        day = f"2024-01-{rnd.randint(1, 9):02d}"
        if rnd.random() < 0.3:
            out.append((host, 0, day, "domain", rnd.choice("ab")))
        else:
            label = int(rnd.random() < 0.1)
            out.append((f"http://{host}/p{rnd.randint(1, 6)}?utm_id={rnd.randint(1, 3)}", label, day, "url", rnd.choice("ab")))
    return out


def brute_clean(rows):
    """Overlap first, then keep-first, on plain Python rows."""
    items = []
    for v, lab, d, t, s in rows:
        url = "" if t == "domain" else v.split("?")[0]
        host = v if t == "domain" else v.split("/")[2]
        items.append((d, -lab, s, v, t, host, url))
    positive = {i[5] for i in items if i[1] == -1}
    items = sorted(i for i in items if not (i[1] == 0 and i[5] in positive))
    first = {}
    for i in items:
        first.setdefault((i[4], i[6] or i[5]), i)
    return {(i[3], -i[1], i[0], i[2]) for i in first.values()}


def test_clean_equals_brute_force_with_and_without_hot_keys(spark):
    for seed in range(3):
        data = random_rows(300, seed)
        parsed = corpus.parse_normalized(rows_of(spark, data))
        want = brute_clean(data)
        for hot_rows in (1, 60, 10**9):
            out = corpus.clean(parsed, hot_rows)
            assert out.columns == CLEAN.names
            got = [(r.original_value, r.label, r.collected_at, r.source) for r in out.collect()]
            assert len(got) == len(set(got)) and set(got) == want
            if seed:
                break


def test_no_host_in_both_classes_and_unique_keys(spark):
    out = corpus.clean(corpus.parse_normalized(rows_of(spark, random_rows(400, 9))))
    mixed = out.groupBy("canonical_hostname").agg(F.countDistinct("label").alias("n")).where("n > 1")
    assert mixed.count() == 0
    assert out.where("record_type = 'url'").groupBy("canonical_url").count().where("count > 1").count() == 0


def test_earlier_benign_addon_evicts_phishing(spark):
    parsed = corpus.parse_normalized(rows_of(spark, [("http://bad.com/x", 1, "2024-05-01", "url")]))
    addon_in = spark.createDataFrame(
        [("bad.com", None, "2024-01-01"), ("not a host", None, None), ("ok.com", " ", None)],
        "input_value string, source string, collected_at string",
    )
    out = {r.sample_text: r for r in corpus.domain_dataset(corpus.clean(parsed), corpus.addon_rows(addon_in)).collect()}
    assert out["bad.com"].label == 0 and set(out) == {"bad.com", "ok.com"}
    assert out["ok.com"].source == "vn_benign_domain_addon" and out["ok.com"].collected_at == "2025-04-07"


def test_url_dataset_unique_flag_changes_nothing(spark):
    out = corpus.clean(corpus.parse_normalized(rows_of(spark, random_rows(200, 4))))
    a, b = corpus.url_dataset(out), corpus.url_dataset(out, unique=True)
    assert a.columns == URL_DATASET.names and sorted(a.collect()) == sorted(b.collect())


def test_stats_add_up(spark):
    data = random_rows(200, 5) + [("", 0, "2024-01-01", "url", "a"), ("x", 1, "2024-01-01", "mail", "a")]
    s = corpus.clean_stats(corpus.parse_normalized(rows_of(spark, data))).first()
    assert s.input_rows == 202 and s.invalid_rows_removed == 2
    assert s.input_rows == s.invalid_rows_removed + s.overlap_rows_removed + s.deduplicated_rows_removed + s.output_rows
    assert s.output_rows == s.benign_rows + s.phishing_rows == s.domain_rows + s.url_rows == len(brute_clean(data[:200]))


def test_last_wins_keeps_first_place(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("a", 3, "z")], "k string, seq int, v string")
    assert {(r.k, r.v, r.seq) for r in last_wins(df, "k", "seq").collect()} == {("a", "z", 1), ("b", "y", 2)}


def test_measured(spark):
    df = spark.range(50)
    small, fits = measured(df, 50)
    assert fits and small.count() == 50
    assert measured(df, 49) == (df, False)


def test_align_adds_missing_columns(spark):
    out = align(spark.createDataFrame([("u", 1)], "original_value string, label long"), NORMALIZED)
    assert out.schema.simpleString() == NORMALIZED.simpleString() and out.first().source is None


def test_group_limit_before_shuffle(spark):
    parsed = corpus.parse_normalized(rows_of(spark, random_rows(20, 1)))
    plan = corpus.clean(parsed)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_host_statistics_are_shuffled_once(spark, tmp_path):
    corpus.parse_normalized(rows_of(spark, random_rows(200, 2))).write.parquet(f"{tmp_path}/parsed")
    out = corpus.class_distribution(corpus.clean(spark.read.parquet(f"{tmp_path}/parsed")))
    out.collect()
    assert "ReusedExchange" in out._jdf.queryExecution().executedPlan().toString()
