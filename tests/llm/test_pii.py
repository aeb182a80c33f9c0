import re

from hypothesis import given, settings
from hypothesis import strategies as st

from embertrail.llm import pii


def brute(t):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) < 256 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[ -]", "", m[0])
        if 14 <= len(d) <= 19 and pii.luhn(d):
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a", "@", ".", "b.c", "1", "255", "4111", " ", "-", "+", "(", ")", "é", "%", "4111111111111111", "\n", "٣"]), max_size=30))
def test_base_spans_match_the_forms(parts):
    assert pii.base_spans("".join(parts)) == brute("".join(parts))


def test_luhn():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


def docs(spark):
    rows = [(i, f"some filler words here call me at +1 (743) 555-{3000 + i} today") for i in range(8)]
    rows += [(100, "please call me at (743) 555-1234 today"), (101, "order number 743 555 1234 shipped"), (102, None), (103, ""), (None, "call me at 743-555-9999"), (100, "please call me at (743) 555-1234 today"), (104, "x " * 20_000 + "a@b.co")]
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'c' as spans", "1 as n_email")


def test_patterns_find_unseen_numbers_and_leave_others(spark):
    out = {}
    for r in pii.find(docs(spark)).collect():
        out.setdefault(r["doc_id"], []).append(r)
    assert [r["spans"] for r in out[100]] == ["phone:18:32"] * 2 and out[100][0]["n_phone"] == 0
    assert out[None][0]["spans"] == "phone:11:23" and out[101][0]["spans"] == ""
    assert out[0][0]["spans"] == "phone:34:51" and out[102][0]["spans"] == "" and out[104][0]["n_email"] == 1


def test_redaction_keeps_columns_and_rows(spark):
    d = docs(spark)
    out = pii.redact(d)
    assert out.columns == d.columns and out.count() == d.count()
    assert {r["text"] for r in out.where("doc_id = 100").collect()} == {"please call me at [PHONE] today"}
    assert pii.find(d.where("false")).count() == 0


def test_spans_of_all_documents_against_brute_force(spark):
    from embertrail.llm.common import table

    d = table(spark, "/root/testdata/sf0.01", "documents")
    texts = {r["doc_id"]: r["text"] for r in d.collect()}
    for r in pii.find(d).collect():
        base = brute(texts[r["doc_id"]])
        assert set(filter(None, r["spans"].split(","))) >= {f"{k}:{s}:{e}" for k, s, e in base}
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(x[0] == k for x in base) for k in pii.KINDS]


def test_base_digest_of_all_documents(spark):
    import hashlib

    from embertrail.llm.common import table

    d = table(spark, "/root/testdata/sf0.001", "documents")
    texts = {r["doc_id"]: r["text"] or "" for r in d.collect()}
    for r in pii.find(d).collect():
        base = brute(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in base).encode()).hexdigest()
        assert r["n_added"] == len([x for x in r["spans"].split(",") if x]) - len(base)


def secrets(n):
    import hashlib

    return [hashlib.sha1(str(i).encode()).hexdigest() for i in range(n)]


def test_seeds_of_further_kinds_need_their_patterns(spark):
    """A long mixed run is a secret where 'token =' says so, and so is a short one there; elsewhere neither is."""
    keys = secrets(12)
    rows = [(i, f'some words here{i} token = "{k}" and more{i} words') for i, k in enumerate(keys)]
    rows += [(100, 'in here token = "ab12cd34ef" is short'), (101, f"part number {keys[3]} of a list"), (102, "part number ab12cd34ef of a list"), (103, "part number of a token")]
    out = {r["doc_id"]: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, k in enumerate(keys):
        at = rows[i][1].index(k)
        assert out[i]["spans"] == f"secret:{at}:{at + 40}" and out[i]["n_added"] == 1
    assert out[100]["spans"] == "secret:17:27" and not any(out[i]["spans"] for i in (101, 102, 103))


def test_without_the_graph_nothing_is_added(spark, monkeypatch):
    """The added spans come from the scored graph alone: with no pattern confident enough only base spans are left."""
    monkeypatch.setattr(pii, "CONFIDENT", 2.0)
    out = pii.find(docs(spark)).collect()
    assert all(r["n_added"] == 0 for r in out) and sum(r["n_phone"] for r in out) == 8


def test_contexts_on_both_sides(spark):
    """Seeds share only the word after them."""
    rows = [(i, f"word{i} +1 (743) 555-{4000 + i} telefonisch word{i}") for i in range(8)] + [(50, "x1 (743) 555-1234 telefonisch y"), (51, "x2 743 555 1234 gramm y")]
    out = {r["doc_id"]: r["spans"] for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[50] == "phone:3:17" and out[51] == ""


def test_words_beside_a_mention():
    t = 'a b = "X" c'
    s = t.index("X")
    assert pii._before(t, s) == ("=", 4) and pii._before(t, 4)[0] == "b" and pii._after(t, s + 1) == "c"
    assert pii._before("X", 0) == ("", 0) and pii._after("X", 1) == "" and pii._before("key=X", 4)[0] == "key="
    long = "w" * 3000
    assert pii._before(f"{long} X", 3001)[0] == long


def test_account_seeds():
    assert pii.is_seed("account", "DE89 3704 0044 0532 0130 00") and not pii.is_seed("account", "DE89 3704 0044 0532 0130 01")
