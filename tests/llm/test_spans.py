"""Secrets and personal data against the plain forms, in Python."""

import hashlib
import random
import re

import pytest

from tidemark.llm import pii, secrets

KEYWORD = "|".join("".join(f"[{c.upper()}{c}]" for c in w) for w in ("password", "passwd", "secret", "token")) + "|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
ASSIGN = re.compile(rf"({KEYWORD})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")


def listed(spans):
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(spans))


def secret_spans(t):
    return (
        [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
        + [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        + [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    )


def luhn(m):
    d = [int(c) for c in m if c.isdigit()][::-1]
    return 14 <= len(d) <= 19 and sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d)) % 10 == 0


def private_spans(t):
    return (
        [(m.start(), 0, "email", m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        + [(m.start(), 1, "ip", m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
        + [(m.start(), 2, "card", m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if luhn(m[0])]
        + [(m.start(), 3, "phone", m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    )


PARTS = {
    "secret": ["password", "PassWD", "secret", "ToKen", "api_key", "APIkey", '"', "'", " ", "  ", ":", "=", "abcdef", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "é", "😀", "\n", "ghp_" + "a1B2" * 9, "://u:pw@h", "password=token: abcdefgh"],
    "private": ["a", "b.c", "@", "_d", ".com", "..", "x-y", "1", "12", "255", "256", ".", "192.168.1.1", "4994226020900891", "4111 1111 1111 1111", "-", " ", "+", "+1 (555) 123-4567", "(", "é", "😀", "0", "  ", "@mail.example.com"],
}


@pytest.mark.parametrize("what", ["secret", "private"])
def test_against_the_plain_forms(spark, what):
    rnd = random.Random(5)
    rows = [(i, "".join(rnd.choice(PARTS[what]) for _ in range(rnd.randint(0, 14))), i) for i in range(1500)]
    rows += [(9000, None, 0), (9001, "", 0), (9002, "x" * 100_000 + " token=abcdefgh a@b.cd", 0), (9003, "12." * 30_000, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans int")
    out = secrets.digest(secrets.scan(df)) if what == "secret" else pii.digest(pii.scan(df))
    got = {r.doc_id: r for r in out.collect()}
    assert len(got) == len(rows)
    for i, t, _ in rows:
        want = (secret_spans if what == "secret" else private_spans)(t or "")
        assert got[i].base_sha256 == hashlib.sha256(listed(want).encode()).hexdigest(), t
        kinds = ("assign", "access", "hex") if what == "secret" else pii.KINDS[:4]
        assert [got[i][f"n_{k}"] for k in kinds] == [sum(s[2] == k for s in want) for k in kinds]
        assert set(listed(want).split(",")) - {""} <= set(got[i].spans.split(","))


def test_queries_name_every_match():
    rnd = random.Random(1)
    for _, e, _ in secrets.RULES:
        q = secrets.query(e)
        for text in ("password=abcdefg", "API_KEY: 'abcdefgh'", "AKIA" + "A" * 16, "ghp_" + "a" * 36, "xoxb-1234567890", "AIza" + "a" * 35, "sk_live_" + "a" * 16, "eyJabcdefgh.eyJabcdefgh.abcdefgh", "-----BEGIN EC PRIVATE KEY-----", "ftp://a:b@c"):
            if re.search(e, text):
                low = text.lower() + rnd.choice(["", "x"])

                def true(x, low=low):
                    return x is True or (x in low if isinstance(x, str) else (all if x[0] == "and" else any)(true(y) for y in x[1]))

                assert true(q)


def test_null_ids_repeated_rows_and_empty_tables(spark):
    df = spark.createDataFrame([(None, "token=abcdefgh"), (1, "token=abcdefgh"), (1, "AKIA" + "B" * 16)], "doc_id long, text string")
    assert sorted(r.n_assign + r.n_access for r in secrets.digest(secrets.scan(df)).collect()) == [1, 1, 1]
    assert secrets.digest(secrets.scan(df.limit(0))).count() == 0
    assert pii.digest(pii.scan(df.limit(0))).count() == 0


def test_terms_that_disclose_an_entity(spark):
    rows = [(i, f"notes {i} Zanzibar harbour mail bob@corp.example today {i}") for i in range(3)] + [(10 + i, f"plain text number {i} about the harbour") for i in range(200)]
    rows += [(500 + i, f"mail ann{i}@corp.example today") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.digest(pii.scan(df)).collect()}
    at = rows[0][1].index("Zanzibar")
    assert f"term:{at}:{at + 8}" in got[0].split(",")
    assert "term" not in got[10] and "harbour" not in got[0]
    assert f"term:{rows[0][1].index('harbour')}" not in got[0]
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert "bob@" not in clean[0] and "Zanzibar" not in clean[0] and "<EMAIL>" in clean[0]
    assert clean[10] == rows[3][1]


def test_terms_disclose_an_entity_from_anywhere_in_a_text(spark):
    far = " and so on" * 60
    rows = [(i, f"dear Zanzibar {i}{far} mail bob@corp.example today") for i in range(3)] + [(10 + i, f"plain text number {i} and so on") for i in range(300)]
    # A term told elsewhere is found in a text where it stands once, before the entity, in another spelling.
    rows += [(400, f"ZANZIBAR{far} BOB@corp.example"), (401, "Zanzibar alone")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.spans.split(",") for r in pii.digest(pii.scan(df)).collect()}
    assert "term:5:13" in got[0] and "term:0:8" in got[400] and got[401] == [""]
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert all("zanzibar" not in clean[i].lower() and "<EMAIL>" in clean[i] for i in (0, 1, 2, 400))
    assert clean[401] == "Zanzibar alone" and clean[10] == rows[3][1]


def test_mail_addresses_of_any_length(spark):
    text = "x a@b" + ".c" * 3000 + " y"
    df = spark.createDataFrame([(0, text)], "doc_id long, text string")
    assert pii.digest(pii.scan(df)).first().spans == listed(private_spans(text)) == f"email:2:{len(text) - 2}"
    assert pii.sanitise(df).first().text == "x <EMAIL> y"


def test_a_great_many_matches_in_one_text(spark):
    text = "".join(f"é{i} a{i}@b.cd token=abcdef{i} " for i in range(40_000))
    df = spark.createDataFrame([(0, text), (1, None)], "doc_id long, text string")
    want = [s for s in private_spans(text) if s[2] == "email"]
    got = pii.digest(pii.scan(df)).where("doc_id = 0").first()
    assert got.n_email == len(want) == 40_000 and [x for x in got.spans.split(",") if x.startswith("email")] == listed(want).split(",")
    assert secrets.digest(secrets.scan(df)).where("doc_id = 0").first().spans == listed(secret_spans(text))
    clean = pii.sanitise(df).where("doc_id = 0").first().text
    assert clean.count("<EMAIL>") == 40_000 and "@" not in clean and clean.startswith("é0 <EMAIL> token=abcdef0 ")


def test_columns_of_any_name_are_kept(spark):
    names = ["mark", "base", "near", "rest", "told", "terms", "found", "row", "own_id", "own_mark", "_mark", "_id", "_hash", "_spans", "spans", "rules", "cand_id"]
    df = spark.createDataFrame([(i, f"mail a{i}@b.cd", *([i] * len(names))) for i in range(5)], "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    clean = pii.sanitise(df)
    assert clean.columns == df.columns
    for r in clean.collect():
        assert r.text == "mail <EMAIL>" and all(r[n] == r.doc_id for n in names)
    assert pii.digest(pii.scan(df)).count() == secrets.digest(secrets.scan(df)).count() == 5


def test_spans_that_overlap_are_replaced_whole(spark):
    rows = [(0, "x 4111 1111 1111 1111@b.cd y"), (1, "+1 555 123 4567@b.cd"), (2, "10.0.0.1@b.cd")]
    for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert not private_spans(r.text) and not any(c.isdigit() for c in r.text.replace("x", "")), r.text


def test_long_user_names_and_ties(spark):
    rows = [(0, "ftp://" + "u" * 200 + ":" + "p" * 300 + "@host"), (1, "same"), (1, "same"), (None, None)]
    got = secrets.digest(secrets.scan(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    assert sorted(r.spans for r in got) == ["", "", "", "url_password:3:508"]


def test_named_documents_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(secrets, "BROADCAST_IDS", 0)
    df = spark.createDataFrame([(i, f"x token=abcdef{i}" if i % 3 else "none") for i in range(50)], "doc_id long, text string")
    assert sum(r.n_assign for r in secrets.digest(secrets.scan(df)).collect()) == 33


def disclosed(rows):
    """The terms that tell of an entity, by the definition, in Python: (text, term) pairs."""
    from collections import defaultdict
    from math import log2

    n = len(rows)
    term = lambda t: {w.lower() for w in re.findall(r"[^\W\d_]{4,}", t)}
    df = defaultdict(int)
    for _, t in rows:
        for w in term(t):
            df[w] += 1
    entity_df, texts, sides, held = defaultdict(int), defaultdict(set), defaultdict(set), {}
    for _, t in rows:
        spans = [s for s in sorted(private_spans(t))]
        rest = t
        for a, _, _, b in spans:
            rest = rest[:a] + " " * (b - a) + rest[b:]
        names = {f"{k}:{t[a:b].lower()}" for a, _, k, b in spans}
        held[t] = (names, term(rest))
        for e in names:
            entity_df[e] += 1
        for a, _, k, b in spans:
            before, after = t[max(a - pii.NEAR, 0) : a], t[b : b + pii.NEAR]
            before = re.sub(r"^\S+", "", before) if a > pii.NEAR else before
            after = re.sub(r"\S+$", "", after) if len(after) == pii.NEAR else after
            for w in term(before) | term(after):
                sides[f"{k}:{t[a:b].lower()}", w].add((before, after))
    for t, (names, words) in held.items():
        for e in names:
            for w in words:
                texts[e, w].add(t)
    out = set()
    for t, (names, words) in held.items():
        for e in names:
            for w in words:
                far = len(texts[e, w]) if min(df[w], entity_df[e]) >= 2 else 0
                co = max(far if far >= 2 else 0, len(sides[e, w]) if len(sides[e, w]) >= 2 else 0)
                if co and entity_df[e] < n:
                    share = log2(n * min(co, df[w], entity_df[e]) / (df[w] * entity_df[e])) / log2(n / entity_df[e])
                    if share >= pii.DISCLOSES:
                        out.add((t, w))
    return out


def test_disclosed_terms_against_the_definition(spark):
    rnd = random.Random(8)
    names, words = [f"p{i}@h.io" for i in range(12)], [f"term{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}" for i in range(60)]
    rows = []
    for i in range(260):
        who = rnd.randrange(12) if rnd.random() < 0.5 else None
        text = [rnd.choice(words) for _ in range(rnd.randint(0, 25))]
        if who is not None:
            text += [f"secretname{'abcdefghijkl'[who]}"] * (rnd.random() < 0.8)
            rnd.shuffle(text)
            text.insert(rnd.randrange(len(text) + 1), names[who])
        rows.append((i, " ".join(text)))
    rows += [(300 + i, rows[i][1]) for i in range(40)]
    want = disclosed(rows)
    got = {r.doc_id: r.spans for r in pii.digest(pii.scan(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert len(want) > 30
    for i, t in rows:
        spans = [x.split(":") for x in got[i].split(",") if x.startswith("term:")]
        assert {t[int(a) : int(b)].lower() for _, a, b in spans} == {w for x, w in want if x == t}, t
