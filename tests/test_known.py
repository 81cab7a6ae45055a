"""Known answers, refusals and properties of the operators."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.functions.ranges import RangeError, bucket, duration, span, step
from tidemark.operators import calc, dash, index, metrics, records, search, see, state
from tidemark.operators import sql as b
from tidemark.sources import formats, frames

S = 1_000_000


def samples(spark, rows, name="m", kind="counter"):
    return spark.createDataFrame([(name, kind, {"host": h}, t, float(v), i) for i, (h, t, v) in enumerate(rows)], "name string, kind string, labels map<string,string>, us long, value double, seq long")


def test_counter_steps_and_the_sample_before_the_range(spark):
    hour = 3600 * S
    inside = [("a", t * S, t) for t in range(0, 3600, 15)]
    r = metrics.aggregate(samples(spark, inside), "increase", 0, hour, hour).collect()
    assert [(x.value, x.samples) for x in r] == [(3585.0, 240)]
    r = metrics.aggregate(samples(spark, [("a", -15 * S, -15 + 15)] + [("a", t * S, t + 15) for t in range(0, 3600, 15)]), "increase", 0, hour, hour).collect()
    assert r[0].value == 3600.0
    fives = metrics.aggregate(samples(spark, inside), "increase", 0, hour, hour // 12).orderBy("at").collect()
    assert [x.value for x in fives] == [285.0] + [300.0] * 11


def test_buckets_add_up_to_the_range_with_resets(spark):
    rnd = random.Random(3)
    rows, v = [], 0
    for t in range(0, 900, 7):
        v = 0 if rnd.random() < 0.1 else v + rnd.randint(0, 5)
        rows.append(("a", t * S, v))
    s = samples(spark, rows)
    whole = metrics.aggregate(s, "increase", 0, 900 * S).first()
    for op in ("increase", "delta"):
        plain, spread = (sorted(metrics.aggregate(s, op, 100 * S, 800 * S, 60 * S, block=b).collect()) for b in (None, 37 * S))
        assert plain == spread
    parts = metrics.aggregate(s, "increase", 0, 900 * S, 60 * S).agg(F.sum("value").alias("v"), F.sum("resets").alias("r")).first()
    assert whole.value == parts.v and whole.resets == parts.r


def test_gap(spark):
    day, hour = 86_400 * S, 3600 * S
    s = samples(spark, [("a", 0, 100), ("a", 10 * day + 12 * hour - 60 * S, 300)])
    r = metrics.aggregate(s, "increase", day, 11 * day, hour).collect()
    assert [(x.at, x.value, x.gap) for x in r] == [(10 * day + 11 * hour, 200.0, True)]


def test_nearest_rank_in_whole_numbers(spark):
    df = spark.range(1, 101).select(F.lit("g").alias("g"), F.col("id").cast("double").alias("v"))
    assert metrics.nearest_rank(df, ["g"], "v", 7, 100).first().value == 7.0


def test_exact_sum_does_not_depend_on_partitions(spark):
    values = [1e308, 1.0, -1e308, 1e-300, 3.5] * 7 + [0.1] * 10
    df = spark.createDataFrame([("g", v) for v in values], "g string, v double")
    import math

    for n in (1, 3, 8):
        assert metrics.exact_sum(df.repartition(n), ["g"], "v").first().v == math.fsum(values)


def test_sums_keep_all_digits(spark):
    from fractions import Fraction

    def near(values):
        try:
            return float(sum(map(Fraction, values)))
        except OverflowError:
            return float("inf")

    rnd = random.Random(1)
    groups = {"thousandths": [0.001] * 5, "large": [1e17, 1.0], "past a double": [1e308, 1e308], "least": [5e-324] * 3, "cancel": [1e300, 1.0, -1e300], "half": [2.0**53, 1.0, 2.0**-60], "zero": [0.0, -0.0]}
    groups |= {f"r{i}": [rnd.choice([-1, 1]) * rnd.random() * 2.0 ** rnd.randint(-1070, 1000) for _ in range(rnd.randint(1, 20))] for i in range(40)}
    groups |= {f"s{i}": [rnd.uniform(-9, 9) / 7 for _ in range(30)] for i in range(40)}
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("none", None), ("inf", float("inf")), ("inf", 1.0)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v double")
    for n in (1, 5):
        got = {r.g: r.v for r in metrics.exact_sum(df.repartition(n), ["g"], "v").collect()}
        assert {k: got[k] for k in groups} == {k: near(vs) for k, vs in groups.items()}
        assert got["none"] is None and got["inf"] == float("inf")


def test_aggregates_keep_all_digits(spark):
    g = samples(spark, [("a", t * S, v) for t, v in enumerate([0.001, 0.002])], kind="gauge")
    assert metrics.aggregate(g, "avg", 0, 10 * S).first().value == 0.0015
    assert metrics.aggregate(samples(spark, [("a", t * S, 0.001) for t in range(5)]), "sum", 0, 10 * S).first().value == 0.005
    c = samples(spark, [("a", t * S, v) for t, v in enumerate([0, 0.004, 0.008])])
    assert metrics.aggregate(c, "increase", 0, 10 * S).first().value == 0.008
    assert metrics.aggregate(c, "delta", 0, 10 * S).first().value == 0.008
    assert metrics.aggregate(samples(spark, [("a", 0, 1e17), ("b", S, 1.0)]), "last", 0, 10 * S).first().value == 1e17
    r = metrics.roll_again(metrics.rollup(samples(spark, [("a", t * S, v) for t, v in enumerate([1e308, 1e308, -1e308, 0.5])]), S, ["name"]), S, 10 * S, ["name"]).first()
    assert (r.total, r.n, r.low, r.high, r["first"], r["last"]) == (1e308, 4, -1e308, 1e308, 1e308, 0.5)
    f = spark.createDataFrame([("x", 0.001, 3, 1), ("x", 0.002, 4, 2), ("y", None, None, 3)], "k string, v double, n int, t long")
    got = {r.k: (r.s, r.m, r.t, r.v, r.n) for r in calc.calculate(f, {"v": {"op": "sum", "as": "s"}}, ["k"]).join(calc.calculate(f, {"v": {"op": "avg", "as": "m"}, "n": {"op": "sum", "as": "t"}}, ["k"]), "k").join(calc.calculate(f, {"v": {"op": "last"}, "n": {"op": "max"}}, ["k"], "t"), "k").collect()}
    assert got == {"x": (0.003, 0.0015, 7, 0.002, 4), "y": (None, None, None, None, None)}
    inc = spark.createDataFrame([("a", 0, 0.001), ("a", 1, 0.002)], "k string, at long, n double")
    assert state.instruments(inc, ["k"], "at", "n", 10, 5).first().added == 0.003


def test_refusals(spark):
    s = samples(spark, [("a", 0, 1)])
    for bad in ({"host": None}, {"host": {"not": "a"}}, {"host": []}, {"host": {"prefix": ""}}):
        with pytest.raises(RangeError):
            metrics.where(F.col("labels"), bad)
    with pytest.raises(RangeError):
        metrics.aggregate(s, "median", 0, 1)
    with pytest.raises(RangeError):
        span(100, since="1s", frm=0)
    with pytest.raises(RangeError):
        span(0, frm=5, to=5)
    with pytest.raises(RangeError):
        b.where({"x": b.UNDEFINED})
    with pytest.raises(Exception, match="not finite"):
        metrics.refuse_unsound(samples(spark, [("a", 0, float("nan"))], kind="gauge")).collect()
    assert duration("15m") == 900 * S and step(0, 3600 * S, 300) == 15 * S


def test_shared_bounds(spark):
    df = spark.createDataFrame([("t", "a", 1.0, 2), ("t", "a", 5.0, 3), ("t", "a", float("inf"), 3), ("t", "b", 2.0, 1), ("t", "b", float("inf"), 2)], "g string, m string, le double, n long")
    assert [(r.le, r.n) for r in metrics.shared_bounds(df, ["g"], "m").collect()] == [(float("inf"), 5)]


def test_raw_spelling(spark):
    df = spark.createDataFrame([('{"k": 42}',), ('{"k": "42"}',), ('{"k": 42.0}',), ('{"kk": 42}',)], "j string")
    assert [r[0] for r in df.select(records.spelled("k", "42", F.col("j"))).collect()] == [True, False, False, False]


def test_page_does_not_split_a_time(spark):
    df = spark.createDataFrame([(t, i) for i, t in enumerate([1, 1, 2, 2, 2, 3])], "us long, seq long")
    assert sorted(r.us for r in records.page(df, 3, newest=False).collect()) == [1, 1]
    assert records.page(df, 6).count() == 6


def test_keyset_pages_cover_the_table(spark):
    df = spark.createDataFrame([(i % 5, i) for i in range(37)], "a int, b int")
    seen, cursor = [], None
    while page := b.page(df, [("a", True), ("b", False)], 8, cursor).collect():
        seen += [(r.a, r.b) for r in page]
        cursor = [page[-1].a, page[-1].b]
    assert seen == sorted(((i % 5, i) for i in range(37)), key=lambda x: (-x[0], x[1]))


def test_levels_and_lines(spark):
    lines = ["ERROR boom", "  at x.y(z)", "Caused by: q", '{"level":50}', "level=warn x=1", "I0101 go"]
    df = spark.createDataFrame([(0, i, x) for i, x in enumerate(lines)], "id int, no int, line string")
    got = records.multi_line(df, ["id"], "no").orderBy("first").collect()
    assert [r.lines for r in got] == [3, 1, 1, 1]
    assert [r[0] for r in df.orderBy("no").select(records.detect_level(F.col("line"))).collect()] == ["error", None, None, "error", "warn", "info"]


def test_alert_states(spark):
    breach = [False, True, True, True, None, False, False]
    df = spark.createDataFrame([("a", i, x) for i, x in enumerate(breach)], "k string, at long, breach boolean")
    got = [r.state for r in calc.alert_states(df, ["k"], "at", "breach", 2).orderBy("at").collect()]
    assert got == ["ok", "pending", "pending", "firing", "firing", "resolved", "ok"]


def test_counter_windows_and_rate_limit(spark):
    log = spark.createDataFrame([(1, t, i, 1) for i, t in enumerate([0, 5, 9, 10, 25, 30])], "user long, at long, seq long, amount long")
    got = [(r.window_begin, r.total) for r in state.counter_windows(log, "user", "at", "amount", 10).orderBy("seq").collect()]
    assert got == [(0, 1), (0, 2), (0, 3), (10, 1), (25, 1), (25, 2)]
    burst = spark.createDataFrame([(1, t, i) for i, t in enumerate([0, 0, 0, 0, 10, 40])], "user long, at long, seq long")
    assert [r.ok for r in state.rate_limit(burst, "user", "at", 3, 30).orderBy("seq").collect()] == [True, True, True, False, True, True]


def test_exposition(spark):
    page = '# TYPE http_requests counter\nhttp_requests_total{code="200",path="a\\"b\\\\c"} 5 1700000000\nhttp_requests_created{code="200"} 1\n# TYPE s summary\ns{quantile="0.5"} 1\ns_sum 3\nbad{a="1",a="2"} 1\n'
    rows = formats.exposition(spark.createDataFrame([(1, page)], "id int, text string"), "id", "text").collect()
    assert [(r.name, r.kind, r.value) for r in rows if r.name] == [("http_requests_total", "counter", 5.0), ("http_requests", "counter", 0.0), ("s_sum", "gauge", 3.0)]
    assert rows[0].labels["path"] == 'a"b\\c' and rows[0].ms == 1_700_000_000_000
    assert sum(r.skipped for r in rows) == 2


def test_other_formats(spark):
    line = lambda x: spark.createDataFrame([(x,)], "value string")
    assert sorted((r.name, r.value, r.us) for r in formats.influx(line("cpu,host=a,region=b usage=1.5,idle=3i 1700000000000000000")).collect()) == [("cpu_idle", 3.0, 1_700_000_000_000_000), ("cpu_usage", 1.5, 1_700_000_000_000_000)]
    assert [(r.name, r.labels, r.us, r.value) for r in formats.series_json(line('{"metric":{"__name__":"m","h":"a"},"values":[1,2],"timestamps":[5,6]}')).collect()] == [("m", {"h": "a"}, 5000, 1.0), ("m", {"h": "a"}, 6000, 2.0)]
    assert formats.docker_json(line('{"log":"hi\\n","stream":"stdout","time":"2024-01-01T00:00:00Z"}')).first().body == "hi"


def test_frames(spark):
    f = frames.frame(spark, [{"a": 9007199254740993, "b": 1, "c": "2024-01-01"}, {"a": None, "b": 1.5, "c": "x", "d": [1]}])
    assert dict(f.dtypes) == {"a": "bigint", "b": "double", "c": "string", "d": "string"}
    assert f.first().a == 9007199254740993
    with pytest.raises(frames.FrameError):
        frames.frame(spark, [{"a": 1}, {"a": "x"}])
    with pytest.raises(frames.FrameError):
        frames.frame(spark, [{"a": 2**60}, {"a": 0.5}])


def test_text(spark):
    assert tx.normalise("Ёлка Ｃafé") == "елка cafe"
    assert tx.close("form", "from", 1) and not tx.close("form", "farm2", 1)
    assert tx.name_tokens("o_custkey") == ["custkey"] and tx.singular("categories") == "category"
    assert [r.w for r in spark.createDataFrame([("日本語の can’t Ёлка ﬁne",), ("ก็ไม่",)], "t string").select(tx.words(F.col("t")).alias("w")).collect()] == [["日本", "本語", "語の", "cant", "елка", "fine"], ["ก็ไ", "ไม่"]]
    assert see.key_stem("o_custkey") == "cust"
    assert see.auto_unit(30) == "day" and see.auto_unit(300) == "week" and see.auto_unit(1000) == "month"


def test_redaction_and_units(spark):
    df = spark.createDataFrame([('{"a":{"password": "x","n":1},"u":"http://me:pw@h/"}',)], "j string")
    assert df.select(records.redact(F.col("j"))).first()[0] == '{"a":{"password": "[redacted]","n":1},"u":"http://me:[redacted]@h/"}'
    two = spark.createDataFrame([("g", "eur"), ("g", "usd")], "g string, unit string")
    with pytest.raises(Exception, match="several units"):
        calc.one_unit(two, "unit", ["g"]).collect()


def test_bucket_is_anchored_at_the_epoch(spark):
    week = 7 * 86_400 * S
    assert spark.range(1).select(bucket(F.lit(-1), week)).first()[0] == -week


def test_jobs(spark):
    calls = ["add", "add", "update", "start", "set", "done", "start", "error", "start", "error", "start", "error", "add", "set", "cancel", "cancel", "add"]
    log = spark.createDataFrame([(1, i, i * 3600 * S, op, str(i), None) for i, op in enumerate(calls)], "id long, seq long, at long, op string, value string, due long")
    got = [(r.answer, r.state, r.attempt) for r in state.job_log(log, attempts=3, dedupe=0).orderBy("seq").collect()]
    assert got == [
        (True, "scheduled", 0), (False, "scheduled", 0), (True, "scheduled", 0), (True, "running", 1), (True, "running", 1), (True, "scheduled", 0), (True, "running", 1), (True, "scheduled", 1), (True, "running", 2), (True, "scheduled", 2), (True, "running", 3), (True, "failed", 3),
        (False, "failed", 3), (True, "scheduled", 0), (True, None, 0), (False, None, 0), (True, "scheduled", 0),
    ]
    burst = spark.createDataFrame([(1, t, i) for i, t in enumerate([0, 2, 4, 20])], "k long, at long, seq long")
    assert [r.run_at for r in state.debounce(burst, "k", "at", 5).orderBy("seq").collect()] == [9, 25]
    assert [r.added for r in state.throttle(burst, "k", "at", 4).orderBy("seq").collect()] == [True, False, True, True]


def test_cron():
    import datetime as dt

    from tidemark.functions import cron

    utc = lambda *x: dt.datetime(*x, tzinfo=dt.UTC)
    assert list(cron.runs("@daily", "Europe/Berlin", utc(2024, 1, 1), utc(2024, 1, 3))) == [utc(2024, 1, 1, 23), utc(2024, 1, 2, 23)]
    assert list(cron.runs("30 2 * * *", "Europe/Berlin", utc(2024, 3, 31), utc(2024, 4, 1))) == [utc(2024, 3, 31, 1)]  # skipped
    assert list(cron.runs("30 2 * * *", "Europe/Berlin", utc(2024, 10, 27), utc(2024, 10, 28))) == [utc(2024, 10, 27, 0, 30)]  # repeated
    assert len(list(cron.runs("*/15 9-10 * * 1-5", "UTC", utc(2024, 1, 1), utc(2024, 1, 8)))) == 40
    for bad in ("* * * *", "61 * * * *", "a * * * *"):
        with pytest.raises(RangeError):
            cron.parse(bad)
    with pytest.raises(RangeError):
        list(cron.runs("@daily", None, utc(2024, 1, 1), utc(2024, 1, 2)))


def test_selectors_parameters_and_branches(spark):
    from tidemark.operators import dash

    inst = spark.createDataFrame([("a", {"site": "kazan", "env": "prod"}), ("b", {"site": "spb"})], "name string, labels map<string,string>")
    assert [r.name for r in dash.chosen(inst, "site=kazan, env=prod").collect()] == ["a"]
    assert dash.chosen(inst, "site=@s", {"s": ["kazan", "spb"]}).count() == 2 and dash.chosen(inst, "all").count() == 2
    for bad in ("", "site=kazn", "site", "site=@none"):
        with pytest.raises(RangeError):
            dash.chosen(inst, bad)
    spec = {"n": {"type": "int"}, "t": {"type": "text", "default": "x"}, "l": {"type": "int", "list": True, "nullable": True}}
    assert dash.parameters(spec, {"n": 1}) == {"n": 1, "t": "x", "l": None}
    for bad in ({}, {"n": "1"}, {"n": True}, {"n": 1, "z": 2}):
        with pytest.raises(RangeError):
            dash.parameters(spec, bad)
    m = spark.createDataFrame([([],), (["eu"],), (["eu", "shop"],), (["us"],)], "branch array<string>")
    assert [dash.heard(m, b, r).count() for b, r in (([], False), (["eu"], False), (["eu"], True), ([], True))] == [1, 1, 2, 4]


def test_candidates():
    from tidemark.operators import candidates as c

    orders = c.Table("orders", "fact", 5000, (c.Column("id", "pk"), c.Column("made_at", "event", correlation=0.95), c.Column("amount", "money"), c.Column("priority", "category", distinct=5), c.Column("rate", "ratio")))
    kinds = c.Table("kinds", "lookup", 8, (c.Column("label", "category", distinct=8),))
    every = c.generate([orders, kinds])
    assert {c.forbidden(x) for x in every if x.table is kinds and x.template != "T8"} == {"H7"}
    assert c.forbidden(c.Candidate("T3", orders, "sum", orders.columns[4], orders.columns[1])) == "H2"
    assert c.forbidden(c.Candidate("T3", orders, "sum", orders.columns[0], orders.columns[1])) == "H1"
    best = c.five(every)
    assert [x.template for x, _ in best] == ["T1", "T2"] and [p for _, p in best] == [-3, 1]
    mixed = c.Table("pay", "fact", 5000, (*orders.columns, c.Column("currency", "currency"), c.Column("status", "category", distinct=3)))
    assert c.forbidden(c.Candidate("T3", mixed, "sum", orders.columns[2], orders.columns[1])) == "H5"
    assert c.abstains(c.Candidate("T3", mixed, "sum", orders.columns[2], orders.columns[1])) == "needs-population"


def test_normalised_letters_as_in_python(spark):
    texts = ["Ёжик Ångström Ｃafé ﬁne ǅ Ĳ", "ÀÉÎÕÜ àéîõü ß İ", "Άλφα ΌΜΙΚΡΟΝ", "Й й Ї ў", "e\u0301 i\u0308", "한국어 กำ がぎ", "plain ascii TEXT 123"]
    got = [r.w for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(tx.normalised(F.col("t")).alias("w")).collect()]
    for t, g in zip(texts[:5] + texts[6:], got[:5] + got[6:], strict=True):
        assert g == tx.normalise(t), t


def test_stems_by_script(spark):
    words = {"ru": [("книгами", "книг"), ("книга", "книг"), ("дом", "дом")], "de": [("zeitungen", "zeit"), ("hund", "hund")], "fr": [("chantees", "chant"), ("mot", "mot")], "es": [("cantando", "cant"), ("sol", "sol")]}
    for language, pairs in words.items():
        df = spark.createDataFrame(pairs, "w string, s string")
        assert all(r.g == r.s for r in df.select("s", tx.stem(F.col("w"), language).alias("g")).collect()), language
    df = spark.createDataFrame([("книгами", "книг"), ("walking", "walk"), ("日本", "日本")], "w string, s string")
    assert all(r.g == r.s for r in df.select("s", tx.stem_by_script(F.col("w")).alias("g")).collect())


def test_typo_distance_counts_a_swap_once(spark):
    rnd = random.Random(2)
    for word in ("worthless", "banana", "aabb"):
        terms = {word}
        for _ in range(300):
            w = list(word)
            for _ in range(rnd.randint(0, 3)):
                p, kind = rnd.randrange(len(w)), rnd.randrange(4)
                if kind == 0:
                    w[p] = rnd.choice("abwz")
                elif kind == 1:
                    w.insert(p, rnd.choice("abwz"))
                elif kind == 2 and len(w) > 2:
                    w.pop(p)
                elif p + 1 < len(w):
                    w[p], w[p + 1] = w[p + 1], w[p]
            terms.add("".join(w))
        df = spark.createDataFrame([(t,) for t in terms], "term string")
        for r in df.select("term", tx.distance(F.col("term"), word).alias("d")).collect():
            for most in (0, 1, 2):
                assert (r.d <= most) == tx.close(word, r.term, most), (word, r.term, r.d)


def test_index_keeps_step_with_its_table(spark, tmp_path):
    rnd = random.Random(4)
    word = lambda: f"w{int(rnd.paretovariate(0.7)) % 60}"
    text = lambda: " ".join(word() for _ in range(rnd.randint(0, 30)))
    rows = {i: text() for i in range(120)} | {500: "", 501: None}
    frame = lambda x: spark.createDataFrame(list(x.items()), "doc_id long, text string")
    own = index.Index(spark, str(tmp_path / "i")).build(frame(rows), "doc_id", "text", files=6)

    def check(own):
        from collections import Counter

        terms = ["w1", "w2", "w17", "new", "absent"]
        want = {(i, t, n, len((x or "").split())) for i, x in rows.items() for t, n in Counter((x or "").split()).items() if t in terms}
        assert {tuple(r) for r in own.postings(terms).collect()} == want
        lengths = [len((x or "").split()) for x in rows.values()]
        assert own.statistics[0] == len(rows) and abs(own.statistics[1] - sum(lengths) / len(rows)) < 1e-9
        df = Counter(t for x in rows.values() for t in set((x or "").split()))
        assert {r.term: r.df for r in own.dictionary().collect()} == dict(df)

    check(own)
    for k in range(2):
        changed = {i: text() + " new" for i in rnd.sample(range(150), 20)}
        gone = rnd.sample(sorted(set(rows) - set(changed)), 5)
        rows = {i: x for i, x in (rows | changed).items() if i not in gone}
        own = own.upsert(frame(changed), "doc_id", "text", deleted=spark.createDataFrame([(i,) for i in gone], "doc_id long"), files=2)
        check(own)
    check(own.compact(str(tmp_path / "j"), files=3))
    assert "PushedFilters: [In(term" in own.postings(["w1", "w2"])._jdf.queryExecution().toString()


def test_clustered_search_recalls_the_nearest(spark):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("q"))
    exact = {(r.query, r.doc) for r in search.vector_top(e, q, 10).collect()}
    found = {(r.query, r.doc) for r in search.clustered(e, q, 10).collect()}
    assert len(exact) == 10 * q.count() and len(exact & found) / len(exact) >= 0.9


def test_running_sums_in_order(spark):
    from tidemark.functions.ordered import running

    rnd = random.Random(1)
    rows = [(x, rnd.randint(0, 5)) for x in {rnd.paretovariate(1.1) for _ in range(3000)}]
    got = {r.x: r.o for r in running(spark.createDataFrame(rows, "x double, n long"), "x", "n", "o", 16).collect()}
    total = 0
    for x, n in sorted(rows):
        assert got[x] == total
        total += n
    assert running(spark.createDataFrame([], "x double, n long"), "x", "n", "o").count() == 0


def test_numbers_as_scripts_write_them(spark):
    want = {5.0: "5", 0.1: "0.1", 1e21: "1e+21", 1e20: "100000000000000000000", 123456789.25: "123456789.25", 1e-6: "0.000001", 1.5e-7: "1.5e-7", -2.5: "-2.5", 0.0: "0", -0.0: "0", 1e300: "1e+300", 1234.0: "1234", 2e7: "20000000", 1.0e10 / 3: "3333333333.3333335", float("inf"): "Infinity", 0.001: "0.001"}
    df = spark.createDataFrame([(k, v) for k, v in want.items()], "x double, s string")
    for r in df.select("x", "s", dash.number_text(F.col("x")).alias("t")).collect():
        assert r.t == r.s, r.x


def test_pages_of_samples_cover_all_in_order(spark):
    s = samples(spark, [("ab"[i % 2], (i // 4) * S, i) for i in range(23)])
    seen, cursor = [], None
    while page := metrics.page(s, 5, cursor).orderBy("series", "us", "seq").collect():
        seen += [r.seq for r in page]
        cursor = (page[-1].name, page[-1].series, page[-1].us, page[-1].seq)
    assert seen == [i for i in range(23) if i % 2 == 0] + [i for i in range(23) if i % 2]


def test_panels_known_and_guessed(spark):
    known = dash.known_panels(spark.createDataFrame([("a", "counter"), ("b", "histogram"), ("c", "odd")], "name string, kind string"))
    guessed = dash.guessed_panels(spark.createDataFrame([], "id long, at timestamp, n double, s string"), "t", ["id"])
    assert sorted(map(tuple, known.collect())) == [("a", "a", "rate", False), ("b", "b", "p95", False)]
    assert sorted(map(tuple, guessed.collect())) == [("t", "at", "rows per day", True), ("t", "n", "sum", True)]
    told = dash.confirmed(guessed, spark.createDataFrame([("t", "n", "revenue")], "source string, title string, meaning string"))
    assert sorted(map(tuple, told.collect())) == [("t", "at", "rows per day", True), ("t", "revenue", "sum", False)]


def test_features_roles_and_key_scores():
    assert see.Feature.of(0).get() == 0 and see.Feature.of(None).state == "absent" and see.Feature.of(3, age=5, oldest=4).state == "stale"
    with pytest.raises(RangeError):
        see.Feature.of(1, allowed=False).get()
    t = lambda name, key, **k: see.Columns(name, dict.fromkeys([key, *k], "int"), key)
    keys = [("link", "a_id", "a", "id"), ("link", "b_id", "b", "id"), ("fact", "a_id", "a", "id"), ("fact", "b_id", "b", "id")]
    assert see.table_role(t("link", "id"), {"id": "identifier", "a_id": "reference", "b_id": "reference"}, keys, 10**6) == "link"
    assert see.table_role(t("fact", "id"), {"id": "identifier", "a_id": "reference", "b_id": "reference", "price": "money"}, keys, 10**6) == "fact"
    assert see.table_role(t("fact", "id"), {"id": "identifier", "a_id": "reference", "b_id": "reference", "day": "event"}, keys, 10**6, (("a_id", "day"),)) == "snapshot"
    assert see.table_role(t("a", "id"), {"id": "identifier", "name": "text"}, keys, 10**6) == "lookup"
    assert see.table_role(t("a", "id"), {"id": "identifier", "made": "created", "changed": "updated"}, keys, 10**6) == "entity"
    assert see.table_role(t("audit_log", "id"), {"id": "identifier", "x": "text"}, keys, 10**6) == "event"
    s = see.key_scores({1, 2, 3}, {2, 3, 4, 5})
    assert (round(s["precision"], 3), s["recall"], round(s["f1"], 3)) == (0.667, 0.5, 0.571) and s["low"] <= s["f1"] <= s["high"]


def test_corpora(spark, tmp_path):
    from tidemark.sources import corpora

    (tmp_path / "qrels").mkdir()
    (tmp_path / "collection.tsv").write_text('1\tsome "text" here\n2\tother\n')
    (tmp_path / "queries.tsv").write_text("7\twhat\n")
    (tmp_path / "qrels.tsv").write_text("7 0 1 1\n7\t0\t2\t0\n\n")
    docs, questions, qrels = corpora.msmarco(spark, str(tmp_path))
    assert sorted(map(tuple, docs.collect())) == [("1", None, 'some "text" here'), ("2", None, "other")]
    assert questions.first().text == "what" and [tuple(r) for r in corpora.relevant(qrels).collect()] == [("7", "1")]
    (tmp_path / "corpus.jsonl").write_text('{"_id": "a", "title": "T", "text": "x"}\n')
    (tmp_path / "queries.jsonl").write_text('{"_id": "q", "text": "y"}\n')
    (tmp_path / "qrels" / "test.tsv").write_text("query-id\tcorpus-id\tscore\nq\ta\t2\n")
    docs, questions, qrels = corpora.beir(spark, str(tmp_path))
    assert (tuple(docs.first()), tuple(questions.first()), tuple(qrels.first())) == (("a", "T", "x"), ("q", "y"), ("q", "a", 2))


def test_backup(spark, tmp_path):
    from tidemark.sources import backup

    df = spark.range(100).selectExpr("id", "id * 2 as n")
    told = backup.backup(spark, {"a": df, "b": df.limit(3)}, str(tmp_path / "x"))
    assert told.count() >= 2 and backup.broken(spark, str(tmp_path / "x")).count() == 0
    assert sorted(backup.restore(spark, str(tmp_path / "x"), ["a", "b"])["a"].collect()) == sorted(df.collect())
    part = next((tmp_path / "x" / "data" / "a").glob("part-*.parquet"))
    (part.parent / f".{part.name}.crc").unlink()
    part.write_bytes(part.read_bytes()[:-1] + b"x")
    assert [r.why for r in backup.broken(spark, str(tmp_path / "x")).collect()] == ["changed"]
    with pytest.raises(ValueError, match="not whole"):
        backup.restore(spark, str(tmp_path / "x"), ["a"])


def test_scrapes_and_probes(spark):
    from tidemark.sources import reads

    df = spark.createDataFrame([("h1", 5_000_000, 200, 10, "# TYPE x counter\nx_total{a=\"b\"} 3\ny 1 2000\n"), ("h2", 6_000_000, 500, 20, "x 1"), ("h3", 7_000_000, None, None, None), ("h4", 1, 200, 9000, "")], "instance string, us long, status int, took_us long, body string")
    got = sorted((r.instance, r.name, r.us, r.value, sorted(r.labels.items())) for r in reads.scraped(df).collect())
    assert [g[:4] for g in got] == [("h1", "x_total", 5_000_000, 3.0), ("h1", "y", 2_000_000_000, 1.0)] or [g[:4] for g in got] == [("h1", "x_total", 5_000_000, 3.0), ("h1", "y", 2_000_000, 1.0)]
    assert got[0][4] == [("a", "b"), ("instance", "h1")]
    assert {r.instance: r.state for r in reads.probes(df, 1000).collect()} == {"h1": "up", "h2": "down", "h3": "down", "h4": "slow"}
    change = spark.createDataFrame([("h1", "up", "down", 5)] * 2, "instance string, was string, state string, us long")
    assert reads.notices(change, "http://x").count() == 1


def test_entries_versions_and_expiry(spark):
    rows = [
        (1, 0, "create", "a", None, None, None), (2, 1, "create", "b", None, None, None), (3, 2, "set", "c", 1, None, None), (4, 3, "set", "d", 1, None, None),
        (5, 4, "take", None, 3, None, None), (6, 5, "get", None, None, None, None), (7, 6, "set", "e", None, 10, None), (8, 15, "get", None, None, None, None), (9, 16, "get", None, None, None, None),
        (10, 20, "set", "f", None, None, 10), (11, 28, "get", None, None, None, None), (12, 37, "get", None, None, None, None), (13, 47, "set", "g", 10, None, None), (14, 48, "create", "h", None, None, None), (15, 49, "expire", None, 14, 5, None), (16, 60, "delete", None, None, None, None),
    ]
    df = spark.createDataFrame([("k", *r) for r in rows], "key string, seq long, at long, op string, value string, version long, ttl long, idle long")
    got = {r.seq: (r.answer, r.value, r.version, r.expires) for r in state.entries(df, "key", "at").collect()}
    assert [got[i][0] for i in range(1, 17)] == ["written", "exists", "written", "conflict", "taken", "missing", "written", "found", "missing", "written", "found", "found", "conflict", "written", "written", "missing"]
    assert got[2] == ("exists", "a", 1, None) and got[4] == ("conflict", "c", 3, None) and got[5][1] == "c" and got[8] == ("found", "e", 7, 16) and got[12] == ("found", "f", 10, 47) and got[15] == ("written", "h", 14, 54)


def test_ranges_in_words():
    from tidemark.functions.ranges import instant, resolve

    now = 1_709_296_496_789_000  # 2024-03-01 12:34:56.789 UTC
    assert instant("now", now) == 1_709_296_496_000_000 and instant("now-1h", now) == 1_709_292_896_000_000
    assert instant("now/d", now, "Europe/Moscow") == 1_709_240_400_000_000 and instant("now/mo", now) == 1_709_251_200_000_000
    assert instant("now/w", now) == 1_708_905_600_000_000 and instant("now-7d/y", now) == 1_704_067_200_000_000
    assert instant("2024-03-01T00:00:00", now, "Europe/Moscow") == 1_709_240_400_000_000
    assert resolve("now-1h", "now", now, width=300)[2] == 15 * S
    for bad in ("yesterday", "now+1h", "now-0d", "", None):
        with pytest.raises(RangeError):
            instant(bad, now)


def test_search_filters_are_exact_in_type(spark):
    docs = ['{"a": 50}', '{"a": "50"}', '{"a": 50.0}', '{"a": [1, 50]}', '{"a": []}', '{"a": null}', '{}', '{"a": true}', '{"a": 9007199254740993}', '{"a": "Ann"}', '{"a": ["x", "Ann", null]}', "not json", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(docs)], "i int, f string")
    ask = lambda **k: [r.i for r in df.where(search.passes(F.col("f"), "a", **k)).orderBy("i").collect()]
    assert ask(values=[50]) == [0, 2, 3] and ask(values=[50.0]) == [0, 2, 3] and ask(values=["50"]) == [1]
    assert ask(values=["Ann"]) == [9, 10] and ask(values=["ann"]) == [] and ask(values=[True]) == [7] and ask(values=[9007199254740993]) == [8] and ask(values=[9007199254740992]) == []
    assert ask(between=(1, 50)) == [3] and ask(between=(50, None)) == [0, 2, 3, 8] and ask(missing=True) == [4, 5, 6, 11, 12]
    with pytest.raises(RangeError):
        search.passes(F.col("f"), "a", values=[None])


def test_paired_evaluations(spark):
    a, b = (spark.createDataFrame([(i, v) for i, v in enumerate(x)], "query int, ndcg double") for x in ([1.0, 0.5, 0.5, 1.0], [0.5, 0.5, 0.0, 1.5]))
    got = search.paired(a, b, "ndcg")
    assert (got["wins"], got["losses"], got["ties"], got["mean"]) == (2, 1, 1, 0.125) and got["low"] <= 0.125 <= got["high"]


def test_branches_names_and_wire(spark):
    m = spark.createDataFrame([(["eu"], i, "x" * 10) for i in range(9)] + [(["us"], 1, "y")], "branch array<string>, seq long, body string")
    assert sorted((r.branch[0], r.seq) for r in dash.branch_log(m, 3).collect()) == [("eu", 6), ("eu", 7), ("eu", 8), ("us", 1)]
    assert sorted(r.seq for r in dash.branch_log(m, 99, 25).collect()) == [1, 7, 8]
    s = samples(spark, [("a", 0, 1), ("b", 1, 2)]).union(samples(spark, [("ab", 5, 1)], name="n2"))
    assert [r.name for r in metrics.names(s, limit=1).collect()] == ["m"] and [r.name for r in metrics.names(s, after="m", limit=5).collect()] == ["n2"]
    assert [r.value for r in metrics.label_values(s, "host", prefix="a", limit=9).collect()] == ["a", "ab"] and [r.label for r in metrics.label_names(s).collect()] == ["host"]
    told = spark.createDataFrame([("m", "%", "old", 1), ("m", "%", "busy", 2)], "name string, unit string, help string, at long")
    assert {r.name: (r.unit, r.help) for r in metrics.described(metrics.names(s), told).collect()} == {"m": ("%", "busy"), "n2": ("", "")}
    import decimal
    import json

    df = spark.createDataFrame([(2**53 + 1, 5, decimal.Decimal("1.50"), float("nan"), 0.5, 'q"', None), (1, None, None, float("-inf"), 1e21, "é", [1])], 'a long, b int, c decimal(5,2), d double, e double, `f"x` string, g array<int>')
    got = [json.loads(r.json) for r in dash.wire_json(df).collect()]
    assert got == [{"a": "9007199254740993", "b": 5, "c": "1.50", "d": "NaN", "e": 0.5, 'f"x': 'q"', "g": None}, {"a": 1, "b": None, "c": None, "d": "-Infinity", "e": 1e21, 'f"x': "é", "g": [1]}]


def test_flows_go_on_after_the_last_kept_unit(spark, tmp_path):
    from tidemark.operators.flows import Run

    calls = []

    def read():
        calls.append("read")
        return spark.createDataFrame([("a", 1, "x"), ("a", 1, "x"), ("b", 2, "y")], "instance string, at long, body string")

    for attempt in range(2):  # the second attempt finds all units kept
        r = Run(spark, str(tmp_path / "runs"), "watch", "r1")
        got = r.collect("collect", read, str(tmp_path / "events"), "instance", "at")
        assert {x.instance: (x.rows, x.window_end) for x in got.collect()} == {"a": (2, 1), "b": (1, 2)}
        states = spark.createDataFrame([("s1", "ok"), ("s2", "firing"), ("s3", "firing")], "subject string, state string")
        found = lambda: spark.createDataFrame([("s1", True), ("s2", True), ("s3", False), ("s4", None)], "subject string, breach boolean")
        moved = r.evaluate("evaluate", found, states)
        assert sorted(map(tuple, moved.collect())) == [("s1", "ok", "firing"), ("s3", "firing", "ok")]
        done = r.commit("commit", moved, states)
        assert sorted((x.subject, x.state) for x in done.where("kind = 'state'").collect()) == [("s1", "firing"), ("s2", "firing"), ("s3", "ok")]
        assert sorted(x.operation for x in done.where("kind = 'notify'").collect()) == ["watch/r1/commit/s1", "watch/r1/commit/s3"]
        acted = r.act("act", moved, lambda s, op: calls.append(op) or f"told {s}")
        assert sorted(x.result for x in acted.collect()) == ["told s1", "told s3"]
    assert calls == ["read", "watch/r1/act/s1", "watch/r1/act/s3"]
    # The same window in another run writes nothing again; two identical rows stay two.
    Run(spark, str(tmp_path / "runs"), "watch", "r2").collect("collect", read, str(tmp_path / "events"), "instance", "at")
    assert spark.read.parquet(str(tmp_path / "events")).count() == 3


def test_costs_order_statements(spark):
    from tidemark.operators import costs

    li, o = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("lineitem", "orders"))
    order = [n for n, _ in costs.by_cost({"join": li.join(o, li.l_orderkey == o.o_orderkey), "one": o.select("o_orderkey"), "all": li})]
    assert order[0] == "one" and order[-1] == "join"
    assert costs.leaders(o.where("o_orderstatus <> 'P'").withColumn("g", F.when(F.col("o_orderkey") % 3 == 0, "a").otherwise("b")), "g", 0.1)["same_leader"]


def test_keys_by_a_learned_model(spark):
    from tidemark.operators import keymodel as km

    rnd = random.Random(3)
    known = []
    for k in range(30):  # schemas of four tables whose links have several styles of names
        names = rnd.sample(["customer", "order", "product", "city", "shop", "invoice", "vendor", "ticket"], 4)
        style = rnd.choice([lambda t: (f"{t}_id", "id"), lambda t: (f"{t[:4]}key", f"{t[:4]}key"), lambda t: (f"{t}_code", f"{t}_code")])
        cols, true = [], set()
        for i, t in enumerate(names):
            n = rnd.randint(20, 200)
            key = style(t)[1] if style(t)[1] != "id" else "id"
            cols.append(km.Fact(t, key, "bigint", n, n, 0, frozenset([1, *(("v", hash((t, j)) if key != "id" else j) for j in range(n))]), True))
            cols.append(km.Fact(t, rnd.choice(["amount", "size", "total"]), "bigint", n, n // 2, 1, frozenset([1, *(("v", 10**6 + j * 7) for j in range(n // 2))])))
            for p in names[:i]:
                if rnd.random() < 0.6:
                    c = style(p)[0]
                    values = [("v", x[1]) for x in next(f for f in cols if f.table == p and f.key).values if isinstance(x, tuple)]
                    some = rnd.sample(values, max(1, len(values) // 2))
                    cols.append(km.Fact(t, c, "bigint", n, len(some), 2, frozenset([1, *some])))
                    true.add((t, c, p, next(f.column for f in cols if f.table == p and f.key)))
        known.append(km.pairs(cols, true))
    import pandas as pd

    model = km.KeyModel.fit(spark, pd.concat(known, ignore_index=True))
    d = "/root/testdata/sf0.001"
    keys = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey"}
    tables = {t: spark.read.parquet(f"{d}/{t}.parquet") for t in [*keys, "lineitem"]}
    got = model.predict(spark, km.pairs(km.facts(tables, keys)))
    true = {("nation", "n_regionkey", "region", "r_regionkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("supplier", "s_nationkey", "nation", "n_nationkey"), ("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey")}
    found = set(got[["child", "column", "parent", "key"]].itertuples(index=False, name=None))
    assert see.key_scores(found, true)["f1"] >= 0.8, (found ^ true)


def test_a_learned_order_of_panels():
    from tidemark.operators import candidates as ca
    from tidemark.operators.ranker import Ranker

    money, day, kind = ca.Column("amount", "money"), ca.Column("day", "event"), ca.Column("kind", "category", distinct=5)
    tables = [ca.Table(f"t{i}", "fact" if i % 2 else "event", 5000, (money, day, kind)) for i in range(12)]
    panels = ca.generate(tables)
    kept = [(c, c.by is not None and c.template == "T2") for c in panels]
    ranker = Ranker.load(Ranker.train(kept).dump())
    allowed = ranker.order(panels)
    assert allowed[0].template == "T2" and all(c.template == "T2" for c in allowed[:12])
    chosen = ranker.choose(panels)
    assert len(chosen) == 5 and max(sum(o.table == c.table for o in chosen) for c in chosen) <= 2
    assert Ranker().order(panels) == sorted((c for c in panels if ca.forbidden(c) is None and ca.abstains(c) is None), key=lambda c: (ca.penalty(c), c.key()))


def test_roles_with_their_evidence():
    ask = lambda *a, **k: see.evidence(*a, **k)
    assert ask("created_at", "timestamp", 9, 10) == ("created", "named") and ask("shipped_on", "timestamp", 9, 10) == ("event", "typed")
    assert ask("birth_date", "date", 9, 10) == ("calendar", "named") and ask("is_deleted", "boolean", 2, 10) == ("deleted", "named")
    assert ask("stock_level", "int", 5, 10) == ("level", "named") and ask("lat", "double", 5, 10) == ("place", "named") and ask("x", "decimal(10,2)", 5, 10) == ("money", "typed")
    assert ask("currency", "string", 3, 10) == ("currency", "named") and ask("email", "string", 3, 10) == ("text", "named") and ask("status", "string", 3, 100) == ("category", "measured")
    assert ask("x", "int", 5, 10, declared="fk") == ("reference", "declared") and ask("user_id", "bigint", 10, 10) == ("identifier", "measured")


def test_column_statistics(spark):
    df = spark.createDataFrame([(i % 3 if i < 90 else 100 + i, None if i % 4 == 0 else "ab") for i in range(100)], "n int, s string")
    got = see.column_statistics(df, "n", most=3, parts=3)
    assert got["null_frac"] == 0 and got["n_distinct"] == -0.13 and got["common"] == ["0", "1", "2"] and got["shares"] == [0.3, 0.3, 0.3] and got["bounds"] == [190, 193, 196, 199]
    got = see.column_statistics(df, "s")
    assert (got["null_frac"], got["avg_width"], got["n_distinct"], got["bounds"]) == (0.25, 2.0, 1, [])
