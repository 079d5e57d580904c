from __future__ import annotations

import hashlib
import random
import re

from kpiloom.llm.licenses import TEMPLATES, scan_licenses, size_bounds


def pairs(text):
    words = re.findall(r"[^\W_]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    return list(zip(words, words[1:]))


def by_hand(rows, templates, threshold=0.8):
    """Every window of every admissible number of words against every template."""
    found = []
    for ident, text, *_ in rows:
        a, best = pairs(text or ""), {}
        for name, texts in templates.items():
            for number, template in enumerate(texts):
                b = pairs(template)
                longest = int((len(b) + 1) * (2 - threshold) / threshold + 1e-9) - 1
                for start in range(len(a)):
                    for end in range(start + 1, min(len(a), start + longest) + 1):
                        if a[start] not in b or a[end - 1] not in b:
                            continue
                        window = set(a[start:end])
                        dice = 2 * len(window & set(b)) / (len(window) + len(set(b)))
                        rank = (-dice, number, start, end - start + 1)
                        if dice >= threshold and (name not in best or rank < best[name]):
                            best[name] = rank
        digest = hashlib.sha256((text or "").encode()).hexdigest()
        found += [(ident, digest, n, round(-d, 9), t, s, w) for n, (d, t, s, w) in best.items()]
    return sorted(found, key=repr)


def result(df):
    return sorted([(r["doc_id"], r["text_sha256"], r["license"], round(r["dice"], 9), r["template"], r["start"], r["words"]) for r in df.collect()], key=repr)


def test_against_all_windows(docs):
    draw, rows = random.Random(6), []
    short = {name: texts[:1] for name, texts in TEMPLATES.items()}
    notices = [t for texts in short.values() for t in texts]
    for i in range(60):
        words = []
        for _ in range(draw.randint(1, 3)):
            words += draw.choices(["the", "license", "plain", "text", "Under", "gnu"], k=draw.randint(0, 30))
            notice = draw.choice(notices).split()
            for _ in range(draw.randint(0, 3)):
                notice[draw.randrange(len(notice))] = draw.choice(["the", "THE", "x-y", "1", "", "MIT MIT MIT"])
            words += notice
        rows.append((i, " ".join(w + draw.choice(["", "", "\n"]) for w in words), "en", "a", 1))
    want = by_hand(rows, short)
    assert len(want) > 30 and result(scan_licenses(docs(rows), short)) == want


def test_planted_anywhere(docs):
    """Notices within a line, wrapped, and whole texts inside long files."""
    filler = " ".join(f"word{i % 97} of the file" for i in range(4000))
    rows, expected = [], []
    for name, texts in TEMPLATES.items():
        for number, text in enumerate(texts):
            wrapped = re.sub(r" (?=\S+ \S+ \S+ \S+$|of |the )", "\n * ", text)
            for body in (f"{filler} {text} {filler}", f"{filler}\n{wrapped}\n{filler}", f"so: {text} And then more."):
                rows.append((len(rows), body, "en", "a", 1))
                expected.append((name, number))
    got = {}
    for row in scan_licenses(docs(rows)).collect():
        got.setdefault(row["doc_id"], {})[row["license"]] = (row["dice"], row["template"])
    for i, (name, number) in enumerate(expected):
        dice, template = got[i][name]
        assert dice == 1.0 and template <= number and (template == number or name == "BSD-3-Clause" or name == "Apache-2.0")
    assert scan_licenses(docs([(1, filler, "en", "a", 1)])).collect() == []


def test_same_notice_many_times(docs):
    rows = [(1, "Licensed beneath the MIT License. " * 20_000, "en", "a", 1), (2, "Released under the MIT License. " * 20_000, "en", "a", 1)]
    assert [(r["doc_id"], r["dice"], r["start"]) for r in scan_licenses(docs(rows)).collect()] == [(2, 1.0, 0)]


def test_size_bounds_lose_nothing():
    for size in range(1, 40):
        fits = {n for n in range(1, 200) if 2 * min(n, size) / (n + size) >= 0.8}
        low, high = size_bounds(size, 0.8)
        assert fits == set(range(low, high + 1))


def test_edges(docs, edge_rows):
    notice = "Released under the MIT License."
    rows = edge_rows + [(None, notice, None, None, None), (None, f"so {notice}", None, None, None), (9, notice, "en", "a", 1), (9, notice, "en", "a", 1)]
    got = [(r["doc_id"], r["license"], r["start"], r["words"]) for r in scan_licenses(docs(rows)).collect()]
    assert sorted(got, key=repr) == sorted([(None, "MIT", 0, 5), (None, "MIT", 1, 5), (9, "MIT", 0, 5), (9, "MIT", 0, 5)], key=repr)
    assert scan_licenses(docs([])).collect() == []
    assert scan_licenses(docs(rows), {}).collect() == []
