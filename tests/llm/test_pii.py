import hashlib
import math
import random
import re
from collections import defaultdict

import pytest

from spanforge.llm.pii import KINDS, REACH, context, entities, find_personal_data, luhn, sanitise
from spanforge.llm.queries import op9_disclosure_sanitiser


def base_spans(text):
    """The patterns as they are written down."""
    text, out = text or "", []
    out += [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for kind, pattern, low, high in ((2, r"[0-9]([\x20-]?[0-9])+", 14, 19), (3, r"\+[0-9][\x20().0-9-]+[0-9]", 10, 15)):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            if low <= len(d) <= high and (kind == 3 or luhn(d)):
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_entities_are_the_patterns_matches():
    rng = random.Random(7)
    parts = ["@", "a.b", "x@y.z", "1", "12.", "255.1.1.1", ".", "+1 (017) 555-7713", " ", "4111 1111 1111 1111", "-", "é", "_%", "(", "+", "0001.2.3.4", "a@b", "256.1.1.1.1"]
    for _ in range(4000):
        t = "".join(rng.choices(parts, k=rng.randint(1, 14)))
        assert [x[:3] for x in entities(t)] == base_spans(t), t


def brute(rows, support=3, threshold=0.75):
    contexts, joint, df = defaultdict(set), defaultdict(set), defaultdict(int)
    for t in rows:
        t = t or ""
        for w in set(re.findall(r"[^\W\d_]{3,}", t.lower())):
            df[w] += 1
        found = entities(t)
        for s, k, e, v in found:
            ws = [w for w in context(t, s, e) if all(w[2] <= s2 or w[1] >= e2 for s2, _, e2, _ in found)]
            seal = tuple(w[0] for w in ws)
            for w in ws:
                contexts[k, v].add(seal)
                joint[k, v, w[0]].add(seal)
    out = []
    for t in rows:
        t = t or ""
        found, own = entities(t), set()
        for s, k, e, v in found:
            for w, ws, we in context(t, s, e):
                if all(we <= s2 or ws >= e2 for s2, _, e2, _ in found):
                    n = len(joint[k, v, w])
                    if n >= support and 1 - math.log(max(df[w], n) / n) / math.log(max(len(rows) / len(contexts[k, v]), 2)) >= threshold:
                        own.add((ws, 4, we))
        out.append(sorted({x[:3] for x in found} | own))
    return out


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").collect()
    want = dict(zip((d.doc_id for d in docs), brute([d.text for d in docs])))
    rows = op9_disclosure_sanitiser(spark, f"/root/testdata/{sf}").collect()
    assert sorted(r.doc_id for r in rows) == sorted(want)
    for r, d in zip(sorted(rows, key=lambda r: r.doc_id), sorted(docs, key=lambda d: d.doc_id)):
        base = base_spans(d.text)
        text = lambda spans: ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in base) for i in range(4)]
        assert r.base_sha256 == hashlib.sha256(text(base).encode()).hexdigest() and r.spans == text(want[r.doc_id])


def test_telling_terms_and_hostile_rows(spark):
    rng = random.Random(9)
    common = [f"common{c}" for c in "abcdefghijklmnopqrst"]
    texts = [" ".join(rng.choices(["plain", "words", "here", "only"] + common, k=30)).replace("common", "com") for _ in range(80)]
    for i in range(6):  # Quillfeather stands near one address only
        texts.append(f"{rng.choice(common)} note {chr(97 + i) * 4} from Quillfeather at qf@mail.example.com {chr(98 + i) * 5} plain words")
    texts += [None, "", "a" * 200_000 + "@", "1" * 100_000, "\U0001F600 10.0.0.1 é", "@a.b@c.d", texts[-1], "y@z.org " * 3000]
    df = spark.createDataFrame([(i if i % 9 else None, t, "t", 0) for i, t in enumerate(texts)], "doc_id long, text string, term string, start int").coalesce(1)
    got = [[(s.start, s.kind, s.end) for s in r.found] for r in sorted(find_personal_data(df).collect(), key=lambda r: r.row)]
    assert got == brute(texts)
    assert any(texts[i][s:e] == "Quillfeather" for i in range(80, 86) for s, k, e in got[i] if k == 4)
    clean = [r.text for r in sanitise(df).collect()]
    assert len(clean) == len(texts) and not any(t and ("qf@mail" in t or "Quillfeather" in t or "10.0.0.1" in t) for t in clean)
    assert sorted(t for t in clean if t and "com" in t and "[" not in t) == sorted(t for t in texts[:80] if "com" in t)
    assert find_personal_data(df.limit(0)).count() == 0 and REACH > 0


def test_copies_do_not_hide_a_telling_term(spark):
    rng = random.Random(10)
    words = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(300)]
    texts = [" ".join(rng.choices(words, k=30)) for _ in range(600)]
    told = [f"{' '.join(rng.choices(words, k=3))} Quillfeather wrote from qf@mail.example.com {' '.join(rng.choices(words, k=3))}" for _ in range(3)]
    for copies in (1, 400):
        rows = texts + told + told[:1] * (copies - 1)
        df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
        got = {r.doc_id: [rows[r.doc_id][s.start:s.end] for s in r.found if s.kind == 4] for r in find_personal_data(df).collect()}
        assert all("Quillfeather" in got[i] for i in range(len(texts), len(rows)))
