import hashlib
import re

from tidemark.llm import op3_pii as P

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def base_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), k, m.end(), kind))
    return sorted(out)


TEXTS = [
    "mail a.b+c@x-y.example.com, c@d or e@f.g.h. and é@é.com ü.x@y.zz",
    "ip 10.0.0.1 999.1.1.1 1.2.3.4.5 0001.02.003.255 host 192.168.1.300",
    "card 4111 1111 1111 1111 and 4111-1111-1111-1112, 5500 0000 0000 0004 9 12345678901234567890123",
    "call +1 (415) 555-2671 or +49.30.1234567- or +12 345 or +1 (415) 555-2671 99999999",
    "\U0001f600 astral é +1 (415) 555-2671 a@b.co \u0001\u0002 4111111111111111",
    "IBAN DE89 3704 0044 0532 0130 00 bad DE89 3704 0044 0532 0130 01 GB82WEST12345698765432",
    "my SSN is 123-45-6789. the order was made long ago and far away, in another town: 123-45-6789 is its number, as can be seen",
    None,
    "",
    "1-" * 3000,
    "a@b" + ".c" * 4000,
    "+1" + "(" * 3000,
    "7" * 20000,
    "a@b.c_d@e.f a@b.c.@x.y %@q.w",
    "1.2.3 1.2.3.4.5.6.7.8 01.2.3.4",
    "no data here, only 12 words and 2024-01-01 dates",
]


def test_base_spans_equal_brute_force(spark):
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(TEXTS)], "doc_id long, text string, spans int")
    got = {r.doc_id: r for r in P.detect(df).collect()}
    for i, text in enumerate(TEXTS):
        want = base_spans(text)
        for kind in BASE:
            assert got[i][f"n_{kind}"] == sum(s[3] == kind for s in want), (i, kind)
        joined = ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in want)
        assert got[i].base_sha256 == hashlib.sha256(joined.encode()).hexdigest(), (i, want, got[i].spans)
        assert set(filter(None, joined.split(","))) <= set(got[i].spans.split(","))


def test_method_adds_checked_spans(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    got = {r.doc_id: r.spans for r in P.detect(df).collect()}
    ibans = [s for s in got[5].split(",") if s.startswith("iban")]
    assert [TEXTS[5][int(a) : int(b)] for _, a, b in (s.split(":") for s in ibans)][-1] == "GB82WEST12345698765432"
    assert sum(s.startswith("ssn") for s in got[6].split(",")) == 1  # the context word is near the first alone
    assert got[15] == ""


def test_redact(spark):
    df = spark.createDataFrame([(1, "write a@b.co or call +1 (415) 555-2671 now", 43, "x"), (None, None, None, "y"), (3, "clean", 5, "z")], "doc_id long, text string, n_chars long, __spans string")
    got = {r.doc_id: r for r in P.redact(df, length_col="n_chars").collect()}
    assert got[1].text == "write <EMAIL> or call <PHONE> now" and got[1].n_chars == len(got[1].text)
    assert got[None].text is None and got[3].text == "clean" and got[1].__fields__ == df.columns
    assert P.redact(df.limit(0)).count() == 0


def test_long_runs_are_read_once(spark):
    """A million characters that no pattern matches, in one run: quadratic matching would take hours."""
    import time

    runs = ["@ " + "a" * 1_000_000, "1.2 " + "7" * 1_000_000, "x@" + "b" * 1_000_000, "+1 " + "(" * 1_000_000, "A" * 1_000_000 + "@"]
    began = time.monotonic()
    got = {r.doc_id: r for r in P.detect(spark.createDataFrame(list(enumerate(runs)), "doc_id long, text string")).collect()}
    assert time.monotonic() - began < 60 and len(got) == len(runs)
    assert all(r.n_email == r.n_ip == r.n_phone == 0 for r in got.values())
