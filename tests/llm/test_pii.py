import hashlib
import re

import pytest

from lodestone.llm.pii import KINDS, find_pii, luhn, masked

SCHEMA = "doc_id bigint, text string, spans string, n_chars bigint"
TEXTS = [
    "mail a.b@c-d.example.com, or x@y@z.de and q@r.s@t.uv end", "ip 1.2.3.4 and 1.2.3.4.5 and 256.1.1.1 10.0.0.300 0001.02.3.4",
    "card 4111 1111 1111 1111 and 4111-1111-1111-1112 or 41111111111111113", "call +1 (988) 555-2485 or +49.30/1 or +4 4 20 7946 0958 12 345", "", None,
    "é@ü.de ée@xy.de. 1 2 3 4 5 6 7 8 9 0 1 2 3 4", "+1((((((((((2 +12345678901234567 @@@ .@. a@b. a@b.c.", "9" * 5000 + ".1.1.1", "x" * 20000 + "@" + "y" * 20000 + ".z",
]


def brute(text):
    text, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return [f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(out)]


def test_base_spans_match_brute_force(spark):
    rows = [(i, t, "clash", 1) for i, t in enumerate(TEXTS)] + [(0, TEXTS[0], "clash", 1), (None, "a@b.cd", "x", 1)]
    got = find_pii(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    for r in got:
        want = brute(TEXTS[r.doc_id] if r.doc_id is not None else "a@b.cd")
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert set(want) <= set(r.spans.split(",")) | ({""} if not want else set())
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w.startswith(k) for w in want) for k in KINDS]


def planted():
    rows = [(i, f"Note {i}: please call me at +1 (555) 010-{1000 + i} today", "x", 0) for i in range(12)]
    rows += [(100 + i, f"also you can call me at 555 010 {2000 + i} or so", "x", 0) for i in range(4)]
    rows += [(200 + i, f"she paid in the year 2000 {3000 + i} of them", "x", 0) for i in range(9)]
    return rows


def test_contexts_discover_unseen_numbers_and_leave_others(spark):
    got = {r.doc_id: r for r in find_pii(spark.createDataFrame(planted(), SCHEMA)).collect()}
    assert all(got[100 + i].spans == "phone:24:36" and got[100 + i].n_added == 1 and got[100 + i].n_phone == 0 for i in range(4))
    assert all(got[200 + i].spans == "" for i in range(9)) and all(got[i].n_added == 0 for i in range(12))


def test_masking(spark):
    rows = planted() + [(900, None, "x", None), (901, "clean text\n", "x", 11)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = masked(df)
    assert out.schema == df.schema
    got = {r.doc_id: r for r in out.collect()}
    assert got[3].text == "Note 3: please call me at [PHONE] today" and got[3].n_chars == len(got[3].text)
    assert got[101].text == "also you can call me at [PHONE] or so" and got[900].text is None and tuple(got[901]) == rows[-1]


@pytest.mark.parametrize("rows", [[], [(None, None, None, None)]])
def test_edges(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    assert find_pii(df).count() == len(rows) and masked(df).count() == len(rows)
