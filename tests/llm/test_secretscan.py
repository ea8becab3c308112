import random
import re

from nearmark.llm.secretscan import BASE_RULES, RULES, Rule, Scanner, find_secrets, mask_secrets, trigram_query, trigrams

# The rules as they are stated: matches left to right, short ones dropped.
PLAIN = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 12),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 16),
}
PARTS = ["password", "PassWD", "secret", "ſecret", "toKen", "toKen", "api_key", "apikey", "api__key", '"', "'", " ", "  ", ":", "=", "é", "AKIA", "akia", "deadbeefdeadbeef", "0" * 17, "ABCDEFGH123456", "abc", "==", "\n", "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a1" * 18]


def texts():
    rng = random.Random(3)
    made = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(1, 40))) for _ in range(800)]
    return ["", "to", "password: token: abcdefghijklmnop", *made, "x " * 2_000_000 + "token=abcdefghijklmnop"]


def plain(text):
    found = []
    for j, (kind, (pattern, group, least)) in enumerate(PLAIN.items()):
        found += [(m.start(), j, kind, m.end()) for m in pattern.finditer(text) if len(m[group]) >= least]
    return [f"{k}:{a}:{b}" for a, _, k, b in sorted(found)]


def test_same_as_plain_search(spark, documents):
    rows = list(enumerate([*texts(), None]))
    got = {r[0]: r["_secrets"] for r in find_secrets(documents(rows, ["secrets", "_searched"])).collect()}
    assert len(got) == len(rows)
    kinds = {r.kind for r in BASE_RULES}
    for i, text in rows:
        assert [f"{s['kind']}:{s['start']}:{s['end']}" for s in got[i] if s["kind"] in kinds] == plain(text or "")


def holds(query, text):
    if query is True or isinstance(query, bytes):
        return query is True or query.decode() in text
    return (all if query[0] == "and" else any)(holds(q, text) for q in query[1])


def test_queries_hold_for_every_match():
    assert trigram_query(r"[0-9a-f]{16,}") is True
    assert trigrams(trigram_query(r"AKIA[A-Z0-9]+")) == {b"aki", b"kia"}
    assert trigram_query(r"(abc|x*)d") is True
    assert trigrams(trigram_query(r"(?:ab){2}c?")) == {b"aba", b"bab", b"abc"}
    for pattern, text in [(r"a[bc]d+e", "xacddde"), (r"(foo|ba[rz])+qu?x", "bazfooqx"), (r"^ab.cde$", "ab-cde"), (r"(ab(?=c))cd", "abcd"), (r"x{3,5}y", "xxxxy")]:
        assert re.search(pattern, text)
        assert holds(trigram_query(pattern), text), pattern
        assert Scanner((Rule("r", pattern),)).order == {"r": 0}


def test_masks_and_keeps_the_rest(spark, documents):
    secret = "token=abcdefghijklmnop"
    df = documents([(1, f"a {secret} b"), (2, "clean"), (3, None), (4, ""), (1, f"a {secret} b")], ["secrets"])
    got = sorted(mask_secrets(df).collect(), key=lambda r: r.doc_id)
    assert [r.text for r in got] == ["a [secret] b", "a [secret] b", "clean", None, ""]
    assert got[0].n_chars == len("a [secret] b") and got[2].n_chars == 5 and got[0].secrets == "kept"
    assert mask_secrets(df.where("false")).count() == 0
    assert {r.kind for r in RULES} >= {"assign", "access", "hex", "pem", "github"}


def test_masking_follows_numbers_only(spark):
    rows = [(1, "password=abcdefghijklmnop", "25"), (2, None, None), (3, "x", "1")]
    for kind, want in (("string", "25"), ("bigint", 8), ("int", 8)):
        df = spark.createDataFrame(rows, "doc_id bigint, text string, n_chars string").selectExpr("doc_id", "text", f"cast(n_chars AS {kind}) AS n_chars")
        got = {r["doc_id"]: r for r in mask_secrets(df).collect()}
        assert got[1]["text"] == "[secret]" and got[1]["n_chars"] == want and got[2]["n_chars"] is None
