import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

import oracle
from pagequarry.llm import chosen_path, components, dedup_names, pii_anchors, queries, secrets_index

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_against_sql(spark, con, name):
    got = queries.QUERIES[name](spark, FOLDER).toPandas()
    want = con.execute(queries.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert oracle.rows_of(got) == oracle.rows_of(want)


# ---------------------------------------------------------------- exact duplicates

def texts_with_copies():
    draw = random.Random(9)
    base = ["".join(draw.choice("ab \n") for _ in range(draw.randint(0, 40))) for _ in range(120)]
    return [(i, draw.choice(base)) for i in range(400)]


@pytest.mark.parametrize("width", [1, 3, 4096])
def test_names_are_equal_for_equal_texts_only(spark, width):
    rows = texts_with_copies()
    table = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = {r["doc_id"]: r for r in dedup_names.exact_dedup(table, width=width).collect()}
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[ \t-\r]+", " ", t), []).append(i)
    assert len(got) == len(rows)
    for text, own in groups.items():
        for i in own:
            r = got[i]
            assert (r["keep_id"], r["group_size"], r["kept"]) == (min(own), len(own), i == min(own))
            assert r["text_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_blocks_that_share_a_key_are_told_apart(spark, monkeypatch):
    """With a key of three values for the first seed, names are drawn again."""
    real = dedup_names._key

    def poor(block, seed):
        if seed:
            return real(block, seed)
        return F.struct((F.xxhash64(block) % 3).alias("h1"), F.lit(0).cast("bigint").alias("h2"))

    monkeypatch.setattr(dedup_names, "_key", poor)
    table = spark.createDataFrame([(i, t) for i, t in enumerate("aabbcdefgh")], "doc_id bigint, text string")
    assert sorted(r["keep_id"] for r in dedup_names.exact_dedup(table).collect()) == [0, 0, 2, 2, 4, 5, 6, 7, 8, 9]


def test_dedup_of_odd_rows(odd, none):
    rows = dedup_names.exact_dedup(odd).collect()
    assert len(rows) == odd.count()
    same = [r for r in rows if r["doc_id"] in (1, 2)]
    assert {r["keep_id"] for r in same} == {1} and sum(r["kept"] for r in same) == 1 and same[0]["group_size"] == 3
    empty = [r for r in rows if r["doc_id"] in (5, 6)]
    assert {(r["keep_id"], r["group_size"]) for r in empty} == {(5, 3)}
    assert dedup_names.exact_dedup(none).count() == 0


# ---------------------------------------------------------------- near duplicates

def brute_classes(rows, width=5, similarity=0.8):
    sets = {}
    for i, t in rows:
        words = (t or "").split()
        sets[i] = {tuple(words[j : j + width]) for j in range(max(1, len(words) - width + 1))} if words else set()
    ids = list(sets)
    links = {i: [] for i in ids}
    for x in range(len(ids)):
        for y in range(x):
            a, b = sets[ids[x]], sets[ids[y]]
            if a and b and len(a & b) >= similarity * len(a | b) - 1e-9:
                links[ids[x]].append(ids[y])
                links[ids[y]].append(ids[x])
    classes = {}
    for i in ids:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        classes[i] = min(seen)
    return {i: (classes[i], len(links[i])) for i in ids}


def near_copies(seed=1, families=25, most=60):
    draw = random.Random(seed)
    rows = []
    for _ in range(families):
        words = [draw.choice("abcdefghijkl") * draw.randint(1, 3) for _ in range(draw.randint(3, 120))]
        for _ in range(draw.choice([1, 2, 3, 8, most])):
            own = list(words)
            for _ in range(draw.randint(0, 4)):
                own[draw.randrange(len(own))] = f"w{draw.randrange(9)}"
            rows.append((len(rows), " ".join(own)))
    return rows


@pytest.mark.parametrize("block", [512, 7])
def test_join_finds_every_link(spark, block):
    rows = near_copies()
    table = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = chosen_path.jaccard_join(table, block=block, broadcast_rows=0 if block == 7 else 10**6).collect()
    want = brute_classes(rows)
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in got} == want
    assert sum(r["kept"] for r in got) == len({c for c, _ in want.values()})


def test_runs_are_enough_for_the_recall():
    few, many = chosen_path.runs_for(0.8, 0.9), chosen_path.runs_for(0.8, 0.9999)
    assert 1 <= few < many < chosen_path.COORDINATES


def test_join_of_odd_rows(odd, none):
    rows = chosen_path.jaccard_join(odd).collect()
    assert len(rows) == odd.count()
    same = [r for r in rows if r["doc_id"] in (1, 2)]
    assert {(r["class_id"], r["n_links"]) for r in same} == {(1, 2)} and sum(r["kept"] for r in same) == 1
    blank = [r for r in rows if r["doc_id"] in (5, 6, 7)]
    assert all(r["class_id"] == r["doc_id"] and r["n_links"] == 0 and r["kept"] for r in blank)
    assert chosen_path.jaccard_join(none).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 200)] + [(1000, i) for i in range(1001, 1300)] + [(2000, 2000), (3001, 3000)]
    table = spark.createDataFrame(edges, "u bigint, v bigint")
    got = {r["node"]: r["component"] for r in components.components(table).collect()}
    want = {i: 0 for i in range(201)} | {i: 1000 for i in range(1000, 1300)} | {3000: 3000, 3001: 3000}
    assert got == want


# ---------------------------------------------------------------- secrets

def brute_secrets(text):
    out = []
    for n, rule in enumerate(secrets_index.RULES):
        for m in re.finditer(rule.pattern, text, re.A):
            if len(m[rule.group]) >= rule.least:
                out.append((m.start(), n, m.end()))
    return [(secrets_index.RULES[n].kind, a, b) for a, n, b in sorted(out)]


def test_trigram_queries():
    assert secrets_index.trigram_query("AKIA[A-Z0-9]+") == [["aki", "kia"]]
    assert secrets_index.trigram_query("[0-9a-f]{32,}") is None
    assert secrets_index.trigram_query("(abc|xy)z*") is None
    assert secrets_index.trigram_query("api_?key") == [["_ke", "api", "i_k", "key", "pi_"], ["api", "ike", "key", "pik"]]
    assert secrets_index.trigram_query("ab?cde") == [["abc", "bcd", "cde"], ["acd", "cde"]]


def test_every_secret_is_found(spark):
    draw = random.Random(6)
    parts = ["password", "Passwd", "SECRET", "token", "api_key", "apiKEY", "AKIA", "eyJ", ".eyJ", "ghp_", " ", ":", "=", '"',
             "'", "0a1b2c3d", "ABCDEFGH12345678", "deadbeef" * 4, "é漢𝔘", "x-y", "-----BEGIN RSA PRIVATE KEY-----", "k", "K"]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randint(0, 25))) for _ in range(500)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    for rows in (0, 10**6):
        got = {r["doc_id"]: r["spans"] for r in secrets_index.scan(table, broadcast_rows=rows).collect()}
        for i, t in enumerate(texts):
            assert [(s["kind"], s["start"], s["end"]) for s in got[i]] == brute_secrets(t), t


def test_secrets_of_odd_rows(odd, none):
    assert secrets_index.scan(odd).count() == odd.count()
    assert secrets_index.scan(none).count() == 0


# ---------------------------------------------------------------- personal data

FORMS = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
]


def brute_personal(text):
    out = []
    for k, form in enumerate(FORMS):
        for m in re.finditer(form, text):
            digits = re.sub("[^0-9]", "", m[0])
            fine = [
                True,
                all(int(p) <= 255 for p in m[0].split(".")) if k == 1 else True,
                13 <= len(digits) <= 19 and pii_anchors.luhn(digits or "0"),
                9 <= len(digits) <= 15,
            ][k]
            if fine:
                out.append((k, m.start(), m.end()))
    return out


@pytest.mark.parametrize("alphabet", ["ab@.-1 ", "0123456789. ", "0123456789 -", "+0123456789 ().-", "a@b.+12 3-()", "é1+.@ 0"])
def test_anchors_find_what_the_forms_say(alphabet):
    finder, draw = pii_anchors.Finder(), random.Random(5)
    for _ in range(4000):
        text = "".join(draw.choice(alphabet) for _ in range(draw.randint(1, 45)))
        assert [s for s in finder.spans(text) if s[0] < 4] == brute_personal(text), text


def test_added_kinds_and_masking():
    text = "see https://a.example/x?y=1 and account: AB123456, card 4111 1111 1111 1111 or +41 44 668 18 00"
    spans = pii_anchors.Finder().spans(text)
    assert [pii_anchors.KINDS[s[0]] for s in spans] == ["card", "phone", "url", "account"]
    assert pii_anchors.masked(text, spans) == "see <URL> and <ACCOUNT>, card <CARD> or <PHONE>"


@pytest.mark.parametrize("form", [
    "IBAN DE89370400440532013000", "Account: 12345678", "ACCT 123456", "account: AB123456", "acct#123456",
    "iban: DE89 3704 0044 0532 0130 00", "Iban: de89 3704 0044 0532 0130 00", "IBAN NO93 8601 1117 947",
    "IBAN number: GB82 WEST 1234 5698 7654 32", "account number 12345678", "account no. 12345678",
    "Account No.: #12345678", "ACCOUNT NUMBER 12345678", "account #12345678", "account NO12345678",
])
def test_usual_forms_of_accounts(form):
    for before, after in (("", ""), ("İ: my ", ", and more"), ("e ", " and 12 more")):
        text = before + form + after
        spans = [s for s in pii_anchors.Finder().spans(text) if s[0] == 5]
        assert spans == [(5, len(before), len(before) + len(form))], text
        assert pii_anchors.masked(text, spans) == f"{before}<ACCOUNT>{after}"


@pytest.mark.parametrize("text", [
    "iban: DE89 3704 0044 0532 0130 01", "account no 12345", "an account of 12345678", "account notes 12345678",
    "iban DE89 3704", "account number", "IBAN DE89  3704 0044 0532 0130 00",
])
def test_other_numbers_are_no_accounts(text):
    assert 5 not in [s[0] for s in pii_anchors.Finder().spans(text)]


@pytest.mark.parametrize("url", ["HTTPS://A.EXAMPLE/x?Y=1", "Http://a.example", "FTP://a.example/b"])
def test_schemes_in_every_case(url):
    assert [s for s in pii_anchors.Finder().spans(f"İ {url} b") if s[0] == 4] == [(4, 2, 2 + len(url))]


def test_added_kinds_still_hold_what_their_twin_finds():
    rules = [(4, r"(?:https?|ftp)://[A-Za-z0-9][A-Za-z0-9./?=&%_#:+~-]*"), (5, r"(?:account|acct|iban)[\x20:#.]{1,3}([A-Z0-9]*[0-9][A-Z0-9]*)")]
    finder, draw = pii_anchors.Finder(), random.Random(6)
    parts = ["account", "acct", "iban", " ", ": ", "#", "AB12", "123456", "no", "number", "NO", "http://", "ftp://", "a", "B", "é", "İ", "."]
    for _ in range(4000):
        text = "".join(draw.choice(parts) for _ in range(draw.randint(1, 20)))
        spans = finder.spans(text)
        for kind, form in rules:
            for m in re.finditer(form, text):
                if kind == 4 or 6 <= len(m[1]) <= 34:
                    assert any(k == kind and a <= m.start() and m.end() <= b for k, a, b in spans), text


def test_personal_data_of_odd_rows(odd, none):
    assert pii_anchors.find(odd).count() == odd.count()
    clean = pii_anchors.redact(odd)
    assert clean.schema == odd.schema and clean.count() == odd.count()
    assert sorted(r["doc_id"] or 0 for r in clean.where("text LIKE '%<EMAIL>%'").collect()) == [1, 1, 2]
    assert clean.where("text IS NULL").count() == 2
    assert pii_anchors.find(none).count() == 0 and pii_anchors.redact(none).count() == 0
