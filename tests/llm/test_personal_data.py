"""Personal data: the added spans against a brute-force version of generators, votes, classifier and overlaps; many matches; extra columns."""

import re
import time

import regex

from erlink.llm import pii


def digits(v):
    return re.sub("[^0-9]", "", v)


def luhn(d):
    return sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def valid(kind, v):
    d = digits(v)
    if kind == "ip":
        return ":" in v or all(int(x) <= 255 for x in v.replace(" ", "").split("."))
    if kind == "card":
        return 14 <= len(d) <= 19 and luhn(d)
    if kind == "phone":
        return 10 <= len(d) <= 15
    if kind == "id" and v[0].isalpha():
        s = v.replace(" ", "")
        return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1
    if kind == "id":
        return not re.search("^(000|666|9)|-00-|-0000$", v)
    return kind == "email" or len(set(v[:64])) >= 8


def votes(kind, v, pre, post):
    strict = {
        "email": r"^[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\Z|[\[(]at[\])].*[\[(]dot[\])]", "ip": r"^[0-9]{1,3}(\.[0-9]{1,3}){3}\Z|:", "card": r"^[0-9]{4}([ -]?[0-9]{4}){3}\Z",
        "phone": r"^(\+[0-9]{1,3}[ .-]?)?\(?[0-9]{2,4}\)?([ .-]?[0-9]{3,4}){2}\Z", "id": "", "secret": rf"^([0-9a-f]{{32}}|[0-9a-f]{{40}}|[0-9a-f]{{64}})\Z|^({pii.CREDENTIALS})|[:=]|(?=.*[a-z])(?=.*[A-Z])(?=.*[0-9].*[0-9])",
    }
    sign = lambda x: 0 if x is None else 1 if x else -1
    gazetteer = {
        "email": lambda: bool(re.search(rf"[. )\]]({pii.DOMAINS})\Z", v.lower())), "ip": lambda: not re.search(r"^(0|127|22[4-9]|2[3-5][0-9])\.", v), "card": lambda: bool(re.search(f"^({pii.ISSUERS})", v)),
        "phone": lambda: bool(re.search(rf"^\+({pii.CALLING_CODES})", v)) if v[0] == "+" else None, "id": lambda: bool(re.search(f"^({pii.IBAN_COUNTRIES})", v)) if v[0].isalpha() else None, "secret": lambda: True if re.search(f"^({pii.CREDENTIALS})", v) else None,
    }
    anti = pii.SECRET_ANTI_CUES if kind == "secret" else pii.ANTI_CUES
    cue = pre + v[:16].lower() if kind == "secret" else pre
    context = -1 if re.search(anti.replace("\\\\", "\\"), pre) else int(bool(re.search(pii.CUES[kind].replace("\\\\", "\\"), cue)))
    edges = not (re.search("[a-z0-9]", pre[-1:]) or re.search("[A-Za-z0-9]", post))
    return {"regex": sign(bool(re.search(strict[kind], v))), "gazetteer": sign(gazetteer[kind]()), "checksum": sign(valid(kind, v)), "context": context, "edges": sign(edges), "shape": min(len(v) // 6, 5) * 4 + min(sum(c in " .-" for c in v), 3)}


def brute_spans(text, model):
    base, sure = [], []
    for kind, pattern, is_base in [(k, p, True) for k, p in pii.BASE.items()] + [(k, p, False) for k, p, _ in pii.WIDE]:
        for m in regex.finditer(pattern, text, regex.ASCII):
            v, s, e = m.group(), m.start(), m.end()
            if is_base and valid(kind, v):
                base.append((s, kind, e))
            elif not is_base and model.log_odds(pii.KINDS.index(kind) + 1, votes(kind, v, text[max(0, s - pii.REACH) : s].lower(), text[e : e + 1])) >= 2.1972245773362196:
                sure.append((s, kind, e))
    over = lambda a, b: a[1] == b[1] and a[0] < b[2] and b[0] < a[2]
    free = sorted((x for x in sure if not any(over(x, b) for b in base)), key=lambda x: (pii.KINDS.index(x[1]), x[0], x[2]))
    added = [x for i, x in enumerate(free) if not any(over(x, y) for y in free[:i])]
    return sorted(base + added, key=lambda x: (x[0], pii.KINDS.index(x[1]), x[2]))


PARTS = (
    "bob (at) mail (dot) com", "amy at site dot org", "bob@mail.com", "10.0.0.1", "10 . 0 . 0 . 1", "300.1.1.1", "2001:0db8:0000:0000:0000:ff00:0042:8329", "4716744394561980", "4716744394561981", "4716 7443 9456 1980", "4716.7443.9456.1980",
    "+1 (667) 555-4827", "(667) 555-4827", "667-555-4827", "0049 30 1234 5678", "123-45-6789", "000-45-6789", "DE89 3704 0044 0532 0130 00", "DE89 3704 0044 0532 0130 01", "04dbebab91ab85687d33eeaaf9ac699e1188f962", "ghp_0a1B2c3D4e5F6g7H8i9J",
    "password = hunter2!", "token = ", "commit ", "card ", "phone: ", "ssn ", "version ", "the ", "é😀 ", "x", "1", "\n", ", ", " ", ". ",
)


def test_added_spans_equal_brute_force(spark):
    import random

    rng = random.Random(11)
    texts = ["".join(rng.choice(PARTS) + rng.choice(["", " ", " ", "; "]) for _ in range(rng.randint(0, 14))) for _ in range(500)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = pii.fit(pii.with_proposals(docs))
    got = {r.doc_id: r for r in pii.detect(docs).collect()}
    n_base = n_all = 0
    for i, t in enumerate(texts):
        want = brute_spans(t, model)
        assert got[i].spans == ",".join(f"{k}:{s}:{e}" for s, k, e in want), (t, want)
        assert got[i].n_spans == len(want)
        n_all += len(want)
        n_base += sum(got[i][f"n_{k}"] for k in pii.BASE_KINDS)
    assert n_all > 1.5 * n_base
    masked = {r.doc_id: r.text for r in pii.mask(docs).collect()}
    for i, t in enumerate(texts):
        out, at = [], 0
        for s, k, e in brute_spans(t, model):
            if s >= at:
                out += [t[at:s], f"<{k.upper()}>"]
            at = max(at, e)
        assert masked[i] == "".join(out) + t[at:], t


def test_the_classifier_decides_among_proposals(spark):
    """Credentials beside a cue are added, numbers that fail their checks are not; no label was given."""
    rows = [(i, f"api token: {i:03d}bebab91ab85687d33eeaaf9ac699e1188f962 is mine") for i in range(60)] + [(100 + i, f"take {9807915762804400 + i} of them") for i in range(60)]
    got = {r.doc_id: r.spans for r in pii.detect(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i].startswith("secret:11:") for i in range(60))
    luhn_ok = {100 + i for i in range(60) if luhn(str(9807915762804400 + i))}
    assert {i for i in range(100, 160) if got[i]} == luhn_ok


def test_many_matches_and_long_texts(spark):
    n = 100_000
    text = "é" + "x@y.zz, " * n
    began = time.time()
    rows = spark.createDataFrame([(1, text), (1, text), (2, "a" * 2_000_000)], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_email, r.n_spans) for r in pii.detect(rows).collect())
    assert got == [(1, n, n), (1, n, n), (2, 0, 0)]
    masked = {r.doc_id: r.text for r in pii.mask(rows).collect()}
    assert masked == {1: "é" + "<EMAIL>, " * n, 2: "a" * 2_000_000}
    assert time.time() - began < 120


def test_columns_of_any_name(spark):
    names = ["doc_id", "text", *(f"m{i}" for i in range(3)), "p0", "_txt", "_found", "_proposals", "_base", "_sure", "_spans", "g", "x", "a.b"]
    rows = spark.createDataFrame([(1, "to bob@mail.com", *names[2:]), (None, None, *names[2:])], ", ".join(f"`{c}` {'long' if c == 'doc_id' else 'string'}" for c in names))
    out = pii.mask(rows)
    assert out.columns == names and sorted(map(str, (r.text for r in out.collect()))) == ["None", "to <EMAIL>"]
    assert {r.spans for r in pii.detect(rows).collect()} == {"email:3:15", ""}
