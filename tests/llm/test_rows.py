"""Operators that judge each text by itself: tokens, counts, licences, personal data, languages."""

import base64
import hashlib
import random
import re
import time
import tracemalloc
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from sample_texts import SAMPLE, prose
from tokenizers import Tokenizer

from folioscan.llm import byte_bpe, language_id, license_scan, private_data, token_counts
from folioscan.llm.bpe import ranked_bytes
from folioscan.llm.license_rules import GATES, rules

ALPHABET = [
    "a", "b", "th", "in", " ", "  ", "\n", "\t", "é", "ß", "Σ", "ς", "İ", "é", "\x1c", "\x85", "　", "1", "23", "'s", "'S", "'ll", "!", "***", "日本",
    "👍🏽", "<|endoftext|>", "<|startoftext|>", "<|", "A", "THE", "\x00", " ", "ﬁ", "xxxxxxx", "aaaa", "==", "¼", "٣", "​",
]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 40))) for _ in range(4000)] + SAMPLE + ["a" * 3000, " " * 1500, "é" * 999, "ab" * 2000]


@pytest.fixture(scope="module")
def library():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_transducer_equals_library_and_round_trips(texts, library):
    c = byte_bpe.codec()
    for t in texts:
        ids = c.encode(t)
        assert ids.tolist() == library.encode_ordinary(t), t[:80]
        assert c.decode(ids) == t


def test_transducer_survives_forgetting(texts, library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "STATES", 40)
    monkeypatch.setattr(byte_bpe, "PIECES", 10)
    c = byte_bpe.Codec(byte_bpe.RANKS, public_tokenizers.PATTERN)
    for t in texts[:800]:
        assert c.encode(t).tolist() == library.encode_ordinary(t)


def test_transducer_keeps_states_in_little_memory():
    rng = random.Random(3)
    words = [bytes(rng.choices(b"abcdefghijklmnopqrstuvwxyz", k=rng.randint(4, 12))) for _ in range(4000)]
    machine = byte_bpe.Transducer(ranked_bytes(byte_bpe.RANKS))
    first = [machine.encode(w) for w in words]  # fills the merge table's own caches
    machine.reset()
    tracemalloc.start()
    again = [machine.encode(w) for w in words]
    del again[:]
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 6_000_000  # 11,638 states; 9.1 MB when each had a dictionary and tuples of its own
    assert [machine.encode(w) for w in words] == first


def test_utf8_machine_takes_bytes_in_any_cut():
    rng = random.Random(2)
    for _ in range(2000):
        raw = bytes(rng.choice([65, 0xC3, 0xA9, 0xE2, 0x82, 0xAC, 0xF0, 0x9F, 0x91, 0x8D, 0xED, 0xA0, 0x80, 0xFF, 0xC0]) for _ in range(rng.randint(0, 9)))
        cuts = sorted(rng.randint(0, len(raw)) for _ in range(2))
        parts = {0: raw[: cuts[0]], 1: raw[cuts[0] : cuts[1]], 2: raw[cuts[1] :]}
        assert byte_bpe.Decoder(parts).decode(np.array([0, 1, 2])) == raw.decode("utf-8", "replace")


def test_encoding_of_odd_rows(odd, odd_rows, nothing, library):
    got = Counter(tuple(r) for r in byte_bpe.digests(odd).collect())
    want = Counter()
    for i, t, *_ in odd_rows:
        ids = library.encode_ordinary(t or "")
        raw = b"".join(x.to_bytes(4, "little") for x in ids)
        want[(i, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())] += 1
    assert got == want
    assert byte_bpe.digests(nothing).count() == 0
    assert byte_bpe.encoded(odd.filter("doc_id = 8")).first()["decoded"] == "one two"


def test_prefix_counts_equal_library(texts):
    lib = Tokenizer.from_file(token_counts.VOCABULARY)
    c = token_counts.counter()
    for t in texts:
        assert c.count(t).total == len(lib.encode(t, add_special_tokens=False).ids), t[:80]
    for word in ("thinking", "été", "internationally", "zzzzqqq", "日本語"):
        _, closed = c.prefixes.of(word.encode())
        for n in range(1, len(word) + 1):
            assert closed[len(word[:n].encode())] == len(lib.encode(word[:n], add_special_tokens=False).ids)


def test_budgets_without_encoding_again(texts):
    lib = Tokenizer.from_file(token_counts.VOCABULARY)
    found = token_counts.counter().count("some thinking about internationalisation of things")
    for budget in range(12):
        word, rest = found.cut(budget)
        prefix = " ".join(found.words[:word]) + (" " + found.words[word].encode()[:rest].decode() if rest else "")
        assert len(lib.encode(prefix, add_special_tokens=False).ids) <= budget
        assert found.at(word, rest) <= budget if rest else True


def test_counts_of_odd_rows(odd, odd_rows, nothing):
    lib = Tokenizer.from_file(token_counts.VOCABULARY)
    got = Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(odd).collect())
    want = Counter()
    for i, t, *_ in odd_rows:
        n = len(lib.encode(t or "", add_special_tokens=False).ids)
        want[(i, len((t or "").encode()), n, n > 2048)] += 1
    assert got == want
    assert token_counts.token_counts(nothing).count() == 0


def scan(text):
    """Detections and labels by plain loops."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate({i: i + 32 for i in range(65, 91)}))
    padded = " " + " ".join(words) + " "
    spans = []
    for r in rules():
        if r.keyword in padded:
            for m in re.finditer(f" ({r.pattern})(?= )", padded):
                first = padded[: m.start()].count(" ")
                spans.append((first, first + m[0].count(" ") - 1, r))
    left = []
    for s in spans:
        inside = [o for o in spans if o is not s and o[0] <= s[0] and s[1] <= o[1] and ((o[0], o[1]) != (s[0], s[1]) or o[2].rank < s[2].rank)]
        if not inside:
            left.append(s)
    base = [s for s in spans if s[2].base]
    labels = {s[2].label for s in left} | {s[2].base for s in base}
    return (
        len(words), len(base), min((s[0] for s in base), default=None), max((s[0] for s in base), default=None),
        ",".join(sorted({s[2].base for s in base})), ",".join(sorted(labels)), max((s[2].weight for s in left), default=0.0), len(left),
    )


def test_there_are_hundreds_of_rules():
    assert len(rules()) > 300


def test_licences(make, odd, odd_rows, nothing):
    texts = [t for _, t, *_ in odd_rows] + SAMPLE + [
        "Licensed under the Apache License, Version 2.0 (the License)", "GNU GENERAL PUBLIC LICENSE v3", "GPLv2 or SPDX-License-Identifier: MIT",
        "the GNU Lesser General Public License version 2.1 and the GNU General Public License", "cc by cc by-sa 4.0 CC-BY", "MIT license " * 50, "mité license",
    ]
    docs = make([(i, t, None, None) for i, t in enumerate(texts)])
    for r in license_scan.license_scan(docs).collect():
        assert tuple(r)[1:] == scan(texts[r.doc_id] or ""), texts[r.doc_id]
    assert license_scan.license_scan(nothing).count() == 0
    assert license_scan.license_scan(odd).count() == len(odd_rows)


def example(rng, parsed):
    """A random text that a parsed pattern matches."""
    out = ""
    for op, arg in parsed:
        name = str(op)
        if name == "LITERAL":
            out += chr(arg)
        elif name == "NOT_LITERAL":
            out += "w"
        elif name == "IN":
            out += "w" if str(arg[0][0]) == "NEGATE" else chr(rng.choice(arg)[1])
        elif name == "BRANCH":
            out += example(rng, rng.choice(arg[1]))
        elif name == "MAX_REPEAT":
            out += "".join(example(rng, arg[2]) for _ in range(rng.randint(arg[0], min(arg[1], arg[0] + 9))))
        elif name == "SUBPATTERN":
            out += example(rng, arg[3])
        else:
            assert name == "ASSERT_NOT", name
    return out


def test_keywords_and_gates_suppress_no_match():
    rng = random.Random(12)
    for r in rules():
        parsed = re._parser.parse(r.pattern)
        for _ in range(60):
            words = f" {example(rng, parsed)} "
            assert re.fullmatch(f" ({r.pattern}) ", words), (r.pattern, words)
            assert r.keyword in words, (r.keyword, words)
            assert any(g in words for g in GATES), words


def test_licences_by_text_and_address(make):
    want = {
        "European Union Public Licence v1.2": "eupl-1.2", "Open Database License 1.0": "odbl-1.0",
        "Open Data Commons Attribution License": "odc-by", "PSF license": "psf",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal": "mit",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:": "bsd",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.": "bsd-3-clause",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.": "0bsd",
        "see https://opensource.org/licenses/MIT": "mit", "http://www.apache.org/licenses/LICENSE-2.0": "apache-2.0",
        "https://creativecommons.org/licenses/by-nc-sa/4.0/": "cc-by-nc-sa-4.0", "https://www.mozilla.org/en-US/MPL/2.0/": "mpl-2.0",
        "https://creativecommons.org/publicdomain/zero/1.0/": "cc0-1.0", "you are permitted to redistribute words": "",
    }
    found = {r.doc_id: r for r in license_scan.license_scan(make([(i, t, None, None) for i, t in enumerate(want)])).collect()}
    for i, (text, label) in enumerate(want.items()):
        assert label in found[i].labels.split(","), (text, found[i].labels)
        assert (found[i].score > 0) == bool(label)


def luhn(d):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
    return sum(n - 9 if n > 9 else n for n in doubled) % 10 == 0


def private(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for kind, pattern, low, high in ((2, r"[0-9]([\x20-]?[0-9])+", 14, 19), (3, r"\+[0-9][\x20().0-9-]+[0-9]", 10, 15)):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            if low <= len(d) <= high and (kind == 3 or luhn(d)):
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def written(spans):
    return ",".join(f"{private_data.KINDS[k]}:{a}:{b}" for a, k, b in spans)


def test_private_data_of_odd_texts(make, odd, odd_rows, nothing):
    rng = random.Random(3)
    bits = ["a", "@", ".", "b.c", "_", "-", " ", "1.2.3.4", "256.1.1.1", "4111 1111 1111 1111", "4111111111111112", "+1 (375) 555-4393", "+12", "é", "👍", "x@y.z", "0001.2.3.004", "\n"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(600)] + ["a@b.c_d@e.f", "a" * 20_000 + "@", "1.2.3.4.5.6.7.8", "x@" + "a." * 5000 + "z"]
    rows = private_data.private_data(make([(i, t, None, None) for i, t in enumerate(texts)])).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = private(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in want) for i in range(4)]
        assert r.base_sha256 == hashlib.sha256(written(want).encode()).hexdigest(), texts[r.doc_id]
        assert [s for s in r.spans.split(",") if s and s.split(":")[0] in private_data.KINDS[:4]] == [s for s in written(want).split(",") if s]
    assert private_data.private_data(odd).count() == len(odd_rows)
    assert private_data.private_data(nothing).count() == 0


def test_terms_that_give_an_entity_away(make):
    """A nickname that stands near one address only, in several texts, is removed; a common word near it stays."""
    rng = random.Random(4)
    plain = [f"common words stand here number {rng.randint(0, 9999)} and nothing else matters" for _ in range(40)]
    telling = [f"common greetings {rng.randint(0, 9999)} from zorblatt to ann@mail.example.org today {i}" for i in range(4)]
    docs = make([(i, t, None, None) for i, t in enumerate(plain + telling)])
    spans = {r.doc_id: r.spans for r in private_data.private_data(docs).collect()}
    for i, t in enumerate(telling, len(plain)):
        at = t.index("zorblatt")
        assert f"remove:{at}:{at + 8}" in spans[i].split(",")
        common = t.index("common")
        assert f":{common}:" not in spans[i]
    assert all(not spans[i] for i in range(len(plain)))
    clean = {r.doc_id: r.text for r in private_data.sanitised(docs).collect()}
    assert "zorblatt" not in clean[len(plain)] and "[EMAIL]" in clean[len(plain)] and clean[0] == plain[0]


def test_a_telling_term_is_marked_wherever_it_stands(make):
    """Far from the entity, in documents without it, and for what entities have in common."""
    rng = random.Random(5)
    filler = lambda n: " ".join(rng.choice(["one", "two", "three", "four"]) for _ in range(n))
    far = [f"zorblatt {filler(60)} {i} {filler(i)} p{i}@secret.example.org" for i in range(4)]  # the domain recurs, no address does
    rows = far + [f"{filler(50)} 10.{i}.7.9" for i in range(60)] + [f"{filler(5)} Zorblatt {filler(5)}"] + [filler(20) for _ in range(60)]
    spans = {r.doc_id: r.spans.split(",") for r in private_data.private_data(make([(i, t, None, None) for i, t in enumerate(rows)])).collect()}
    assert len(far[0].split("p0@")[0]) > 200
    for i, t in enumerate(rows):
        at = t.lower().find("zorblatt")
        assert any(s.split(":")[0] in ("remove", "generalise") and s.split(":")[1:] == [str(at), str(at + 8)] for s in spans[i]) == (at >= 0)
    assert not any(s.startswith(("remove", "generalise")) for i in range(4, len(rows)) if i != 64 for s in spans[i])


def test_disclosure_equals_brute_force(make):
    rng = random.Random(6)
    texts = [" ".join(rng.choice(["ab", "cd", "ef", "gh", "ij", "kl@m.no", "pq@m.no", "10.1.2.3", "10.1.2.4", "É"]) for _ in range(rng.randint(0, 6))) for _ in range(160)]
    docs = make([(i, t, None, None) for i, t in enumerate(texts)])
    got = {r.term: r.kind for r in private_data.disclosing(docs, private_data.scanned(docs)).collect()}
    own = [{w.lower() for w in t.split() if w.isalpha()} for t in texts]
    held = []
    for t in texts:
        e = set()
        for w in t.split():
            if "@" in w:
                e |= {"email:" + w, "local:" + w[:2], "domain:m.no", "kind:email"}
            if w[0] == "1":
                e |= {"ip:" + w, "net3:10.1.2", "net2:10.1", "kind:ip"}
        held.append(e)
    want, n = {}, len(texts)
    for e in set().union(*held):
        n_e = sum(e in h for h in held)
        for t in set().union(*own):
            both = [i for i in range(n) if e in held[i] and t in own[i]]
            if both and n_e < n:
                share = np.log(n * len(both) / (sum(t in o for o in own) * n_e)) / np.log(n / n_e) * (1 - private_data.DISCOUNT / len({texts[i] for i in both}) ** 2)
                want[t] = max(share, want.get(t, 0))
    assert got == {t: private_data.KINDS.index("remove" if v >= private_data.REMOVE else "generalise") for t, v in want.items() if v >= private_data.GENERALISE}


def test_a_text_of_many_numbers_takes_linear_time(spark):
    from pyspark.sql import functions as F

    text = " ".join(str(10 + i % 90) + "," for i in range(100_000))
    df = spark.createDataFrame([(text,)], "text string")
    start = time.perf_counter()
    found = df.select(private_data.located(F.col("text"), private_data.CARD).alias("d")).select(F.size("d").alias("n"), F.element_at("d", -1).alias("last")).first()
    assert time.perf_counter() - start < 15 and found.n == 100_000 and (found.last.start, found.last.stop) == (len(text) - 3, len(text) - 1)


def test_languages(make, odd, odd_rows, nothing):
    rng = random.Random(6)
    rows, truth = [], []
    for i in range(240):
        lang = ("de", "en", "es", "fr")[i % 4]
        truth.append(lang)
        declared = lang if i % 6 else rng.choice([None, "xx", "de", "en"])  # some declare nothing or the wrong language
        rows.append((i, prose(rng, rng.choice([3, 20, 200]), lang), declared, f"s{i % 4}"))
    found = {r.key: r for r in language_id.identified(language_id.of_documents(make(rows))).collect()}
    right = sum(found[i].lang == truth[i] for i in range(240))
    assert right >= 235 and all(found[i].kept for i in range(240))
    odd_found = language_id.identified(language_id.of_documents(odd)).collect()
    assert len(odd_found) == len(odd_rows)
    assert {r.kept for r in odd_found if r.key in (0, 1)} == {False}
    assert language_id.identified(language_id.of_documents(nothing)).count() == 0
    assert language_id.accepted(odd).columns == odd.columns


STRANGE = [
    "人人生而自由，在尊严和权利上一律平等。他们赋有理性和良心，并应以兄弟关系的精神相对待。", "Все люди рождаются свободными и равными в своем достоинстве и правах.",
    "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw.", "Tutti gli esseri umani nascono liberi ed eguali in dignità e diritti.",
    base64.b64encode(random.Random(8).randbytes(300)).decode(), "!!!! #### %%%% " * 20, "0123456789 " * 20, "aaaa " * 50,
]


def test_strange_texts_have_no_language(make):
    """Junk and languages that no text declares are rejected, with or without a declaration; clean texts stay."""
    rng = random.Random(9)
    rows = [(i, prose(rng, 60, ("de", "en", "es", "fr")[i % 4]), ("de", "en", "es", "fr")[i % 4], f"s{i % 3}") for i in range(120)]
    rows += [(200 + i, t, (None, "pl", "en")[i % 3], "s1") for i, t in enumerate(STRANGE)]
    found = {r.key: r for r in language_id.identified(language_id.of_documents(make(rows))).collect()}
    assert all(found[i].kept and found[i].lang == rows[i][2] for i in range(120))
    assert {(r.lang, r.kept) for k, r in found.items() if k >= 200} == {("und", False)}
    assert language_id.accepted(make(rows)).count() == 120


def test_declared_languages_are_learnt(make):
    rng = random.Random(10)
    words = STRANGE[2].split()
    rows = [(i, " ".join(rng.choices(words, k=20)), "pl", "a") for i in range(20)] + [(50 + i, prose(rng, 40), "en", "a") for i in range(20)]
    found = {r.key: r for r in language_id.identified(language_id.of_documents(make([*rows, (99, STRANGE[2], None, "a")]))).collect()}
    assert all(found[i].kept and found[i].lang == ("pl" if i < 50 else "en") for i, *_ in rows)
    assert (found[99].lang, found[99].kept) == ("pl", True)


def test_page_evidence(spark):
    pages = spark.createDataFrame([(1, "https://u@www.site.example.de:80/x?y", '<html LANG="fr-CA"><script>var x</script><p>hello</p>'), (2, None, None)], "page_id long, url string, html string")
    a, b = (r.asDict() for r in language_id.of_pages(pages).orderBy("key").collect())
    assert (a["declared"], a["suffix"], a["host"], a["domain"], a["text"].split()) == ("fr", "de", "www.site.example.de", "example.de", ["hello"])
    assert (b["declared"], b["suffix"], b["host"], b["text"]) == ("none", "none", "", "")
