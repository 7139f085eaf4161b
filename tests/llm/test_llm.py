"""Training-data operators against brute force, round trips and odd inputs."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import bpe, decontaminate, kernels, language, media, near_dups, notices, packing, token_counts, tool_calls, toxicity

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ODD = [None, "", "!!! ...", "One two", "Ünï çode ñ 日本語 🙂 words", "same words here again and again", "same words here again and again", "x " * 20_000]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empties, repeated rows, a long text and extra columns with clashing names."""
    rows = [(i, t, "en", "node", 1.0) for i, t in enumerate(ODD)] + [(None, "no id", None, None, None), (3, "One two", "en", "s", 2.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, node string, score double")


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def test_ids_are_those_of_tokenizers():
    from tokenizers import Tokenizer

    t, plain = Tokenizer.from_file(bpe.default_path()), Tokenizer.from_file(bpe.default_path())
    plain.encode_special_tokens = True
    long = [" " * 2_000_000, "\t" * 2_000_000, "x" + "\n \n" * 700_000 + "y", "a" * 300_000, " " * 99_999 + "end"]
    for text in [x for x in ODD if x is not None] + ["a<|endoftext|>b", "<|endoftext|>", "  a  b\t\n c", "it's 'S I'll \x85", *long]:
        assert bpe.encoder().encode(text).tolist() == t.encode(text, add_special_tokens=False).ids
        assert bpe.encoder(ordinary=True).encode(text).tolist() == plain.encode(text, add_special_tokens=False).ids
    assert bpe.encoder().encode("a<|endoftext|>b").tolist() == [64, 50256, 65] and 50256 not in bpe.encoder(ordinary=True).encode("a<|endoftext|>b")


def test_words_match_pattern():
    texts = [t or "" for t in ODD]
    raw, at = kernels.utf8(pa.array(texts))
    hashes, begin = kernels.word_hashes(raw, at)
    assert np.diff(begin).tolist() == [len(WORD.findall(lower(t))) for t in texts]
    known = {}
    for h, w in zip(hashes.tolist(), (w for t in texts for w in WORD.findall(lower(t))), strict=True):
        assert known.setdefault(h, w) == w


def test_packing_round_trip(spark, odd, none):
    rows = packing.pack(odd).collect()
    seen = {}
    for r in rows:
        assert r.length & (r.length - 1) == 0 and r.length <= 1024 and r.offset == 0
        seen.setdefault(r.doc_id, []).append(r)
    assert len({r.sequence_id for r in rows}) == len(rows)
    ids = np.append(bpe.encoder().encode(ODD[4]), 0).astype("<u4")
    for r in seen[4]:
        assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length]) and r.doc_tokens == len(ids)
    assert sum(r.length for r in seen[7]) == len(bpe.encoder().encode(ODD[7])) + 1
    assert packing.pack(none).count() == 0


def test_token_counts(odd, none):
    got = sorted((str(r.doc_id), r.n_tokens) for r in token_counts.token_counts(odd).collect())
    want = sorted((str(r.doc_id), len(bpe.encoder().encode(r.text or ""))) for r in odd.collect())
    assert got == want
    assert token_counts.token_counts(none).count() == 0


def test_scan_stitches_blocks(spark, tmp_path):
    ids = np.array([1, 9, 9, 2, 3, 4, 5, 6, 7, 9, 8], "<u2")
    (tmp_path / "a.bin").write_bytes(ids.tobytes())
    files = spark.createDataFrame([(f"file://{tmp_path}/a.bin", len(ids))], "path string, size long")
    for block in (1, 2, 3, 100):
        got = [(r.ordinal, r.start, r.n_tokens, r.closed) for r in token_counts.scan_token_files(files, separator=9, block=block).orderBy("ordinal").collect()]
        assert got == [(0, 0, 1, True), (1, 2, 0, True), (2, 3, 6, True), (3, 10, 1, False)]


def test_decontamination_and_odd_inputs(spark, odd, none):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    bench = spark.createDataFrame([(1, item), (2, "short one"), (3, None), (4, "...")], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"before {item.upper()}, after"), (2, "a Short, one."), (3, "alpha beta gamma"), (4, None)], "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in decontaminate.scan(docs, bench).collect()}
    assert got[1] == (13, 11, 1, hashlib.sha256(b"1").hexdigest())
    assert got[2] == (3, 2, 1, hashlib.sha256(b"2").hexdigest())
    assert got[3][1:] == got[4][1:] == (0, 0, hashlib.sha256(b"").hexdigest())
    assert sorted(r.doc_id for r in decontaminate.remove_documents(docs, bench).collect()) == [3, 4]
    assert [r.text for r in decontaminate.remove_spans(docs, bench).orderBy("doc_id").collect()][:2] == ["before after", "a "]
    assert decontaminate.scan(odd, bench).count() == odd.count() and decontaminate.remove_documents(odd, bench).columns == odd.columns
    assert decontaminate.scan(none, bench).count() == 0
    assert decontaminate.scan(docs, bench.where("false")).where("contaminated").count() == 0


def test_decontamination_without_a_broadcast(spark, odd, monkeypatch):
    """Beyond the bound, windows are joined by a shuffle: the results are the same."""
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 0)
    test_decontamination_and_odd_inputs(spark, odd, odd.where("false"))


def test_samples_agree_with_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 300).astype(np.uint64)
    b = np.concatenate([a[:270], rng.integers(0, 2**63, 30).astype(np.uint64)])
    agree = []
    for _ in range(20):
        salt = np.uint64(rng.integers(1, 2**62))
        x, y = kernels.mix(a ^ salt), kernels.mix(b ^ salt)
        agree.append((near_dups.samples(x, np.ones(300)) == near_dups.samples(y, np.ones(300))).mean())
    assert abs(np.mean(agree) - 270 / 330) < 0.05


def test_near_duplicates(spark, odd, none):
    rng = np.random.default_rng(3)
    base = " ".join(f"w{n}" for n in rng.integers(0, 5000, 300))
    near = base.replace(base.split()[150], "changed", 1)
    rows = [(5, base), (6, near), (7, base.upper()), (8, " ".join(f"v{n}" for n in rng.integers(0, 5000, 300))), (9, None), (10, None), (11, ""), (12, "")]
    docs = spark.createDataFrame([*rows, (5, base)], "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_dups.classes(docs).collect()}
    assert got == {5: 5, 6: 5, 7: 5, 8: 8, 9: 9, 10: 10, 11: 11, 12: 11}
    nulls = spark.createDataFrame([(None, base), (None, near), (None, base), (None, ""), (4, "")], "doc_id long, text string")
    assert [r.class_id for r in near_dups.classes(nulls).collect() if r.class_size == 3] == [None] * 3
    assert sorted(str(r.doc_id) for r in near_dups.one_of_each(nulls).collect()) == ["4", "None"]
    assert sorted(r.doc_id for r in near_dups.one_of_each(docs).collect()) == [5, 8, 9, 10, 11]
    assert near_dups.classes(odd).count() == odd.count() and near_dups.one_of_each(odd).columns == odd.columns
    assert near_dups.classes(none).count() == 0


def test_near_duplicates_in_a_crowd(spark):
    """60 texts share most of a passage, but only each one's twin is a near duplicate: every twin is found."""
    rng = np.random.default_rng(4)
    passage, rows, want = [f"p{n}" for n in range(170)], [], {}
    for k in range(60):
        own = [*passage, *(f"o{k}x{n}" for n in range(60))]
        twin = list(own)
        twin[int(rng.integers(0, 170))] = f"changed{k}"
        rows += [(k, " ".join(own)), (1000 + k, " ".join(twin))]
        want |= {k: k, 1000 + k: k}
    got = {r.doc_id: r.class_id for r in near_dups.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


CALL = "group_id string, call_id string, name string, arguments string, after array<string>, position long, extra int"


def test_tool_calls(spark):
    calls = [("g", "a", "ask", '{"turn": 1, "text": "x"}', ["b", "zz"]), ("g", "b", "ask", "{", []), ("g", "c", "no", "{}", ["d"]), ("g", "d", "ask", None, ["c"]), ("g", None, "ask", "{}", None)]
    calls += [("g", "e", "ask", '{"text": "first"}', None), ("g", "e", "ask", '{"text": "other"}', None), ("g", "e", "ask", '{"text": "other"}', None)]
    calls = spark.createDataFrame([(*c, i, 0) for i, c in enumerate(calls[:6])] + [(*c, 5, 0) for c in calls[6:]], CALL)
    results = spark.createDataFrame([("a", "done"), ("q", "lost"), ("e", "one"), ("e", "two"), ("e", None), (None, "?")], "call_id string, content string")
    rows = tool_calls.link_tool_calls(calls, results, {"ask": {"text": {"type": "string", "required": True}, "turn": {"type": "integer", "minimum": 0}}}).collect()
    got = {r.call_id: r for r in rows if r.call_id != "e"}
    assert (got["a"].level, got["a"].status, got["a"].valid, got["a"].position) == (1, "linked", True, 0)
    assert got["a"].line == '{"arguments":{"text":"x","turn":1},"id":"a","name":"ask","result":"done"}'
    assert (got["b"].level, got["b"].valid, got["b"].problems) == (0, False, "arguments: not JSON")
    assert got["c"].level is None and got["d"].level is None and got["q"].status == "orphan" and got["q"].level is None
    assert sum(r.status == "unidentified" for r in rows) == 2
    repeats = sorted((r.status, r.n_calls, r.n_results, r.line.split('"result":')[1], r.valid) for r in rows if r.call_id == "e")
    assert repeats == [("linked", 3, 3, '"one"}', True), ("repeated_call", 2, 0, "null}", False), ("repeated_result", 0, 1, '"two"}', False), ("repeated_result", 0, 1, "null}", False)]
    assert tool_calls.link_tool_calls(calls.where("false"), results.where("false"), {"ask": {}}).count() == 0


def test_arguments_against_schemas(spark):
    rule = {"t": {"type": "string", "min_length": 2, "max_length": 3}, "n": {"type": ["number", "null"], "minimum": 1, "maximum": 2.5}, "e": {"enum": ["a", 1]}, "b": {"type": "boolean"}, "l": {"type": "array"}, "o": {"type": "object", "required": True}}
    cases = {
        '{"o": {}}': "",
        '{"o": {}, "t": "abc", "n": 2.5, "e": "a", "b": true, "l": []}': "",
        '{"o": {}, "n": null, "e": 1}': "",
        '{"t": "a", "n": 3, "e": "1", "b": "true", "l": {}, "z": 1}': "b: not boolean; e: not one of enum; l: not array; n: too large; o: missing; t: too short; z: unknown",
        '{"o": [], "t": "abcd", "n": 0.5}': "n: too small; o: not object; t: too long",
        '{"o": null, "t": null}': "o: not object; t: not string",
        "[]": "o: missing",
        "nope": "arguments: not JSON",
    }
    df = spark.createDataFrame([(c,) for c in cases], "a string").withColumn("p", F.try_parse_json("a"))
    got = {r.a: r.w for r in df.select("a", F.concat_ws("; ", tool_calls.problems(F.lit("f"), F.col("p"), {"f": rule}, F.col("a"))).alias("w")).collect()}
    assert got == cases
    with pytest.raises(ValueError, match="unknown schema types"):
        tool_calls.problems(F.lit("f"), F.col("p"), {"f": {"x": {"type": "date"}}})


def test_levels_against_brute_force(spark):
    import random

    rng = random.Random(7)
    after = {f"line{i}": [f"line{i - 1}", f"line{i - 2}"] for i in range(150)}
    after |= {f"d{i}": [f"d{rng.randrange(i)}" for _ in range(rng.randrange(4))] if i else [] for i in range(60)}
    after |= {"r1": ["r2"], "r2": ["r3"], "r3": ["r1"], "r4": ["r3", "d5"], "r5": ["r4"], "s": ["s"], "t": ["s", "d1"]}
    after |= {"k1": ["k2", "k3"], "k2": ["k1", "k3"], "k3": ["k1", "k2"], "k4": ["k1"], "k5": ["k4", "d9"], "none": None}
    after |= {"k6": ["k1", "k2", "k3", "d3"], "r6": ["r1", "r2", "r3", "d3"]}
    for width in (2, 3, 4, 7):
        after |= {f"w{width}.{k}.{i}": [f"w{width}.{k - 1}.{j}" for j in range(width)] if k else None for k in range(14) for i in range(width)}
    after |= {f"fan{i}": [f"d{j}" for j in range(40)] + [f"fan{i - 1}"] for i in range(5)}

    depth = {}
    while True:
        ready = {c: 1 + max((depth[p] for p in ps or [] if p in after), default=-1) for c, ps in after.items() if c not in depth and all(p in depth for p in ps or [] if p in after)}
        if not ready:
            break
        depth |= ready
    rows = spark.createDataFrame(list(after.items()), "call_id string, after array<string>")
    assert {r.call_id: r.level for r in tool_calls.levels(rows).collect()} == {c: depth.get(c) for c in after}


def brute_classes(rows, least):
    """Classes of (id, text) by weighted Jaccard similarity of every pair with a common shingle, in plain Python."""
    import math
    from collections import Counter

    def bag(text):
        w = WORD.findall(lower(text))
        return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()

    bags = [bag(t) for _, t in rows]
    n = sum(1 for b in bags if b)
    frequency = Counter(s for b in bags for s in b)
    weight = {s: 1 + math.log(n / k) / math.log(1 / near_dups.COMMON) if k >= near_dups.COMMON * n else 2.0 for s, k in frequency.items()}
    holders = {}
    for k, b in enumerate(bags):
        for s in b:
            holders.setdefault(s, []).append(k)
    up, near = list(range(len(rows))), set()

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    total = [sum(t * weight[s] for s, t in b.items()) for b in bags]
    for i, (_, text) in enumerate(rows):
        meet = Counter()
        for s, t in bags[i].items():
            for j in holders[s]:
                if j < i:
                    meet[j] += weight[s] * min(t, bags[j][s])
        for j, common in meet.items():
            if common / (total[i] + total[j] - common) >= least:
                near.add((rows[j][0], rows[i][0]))
                up[max(find(i), find(j))] = min(find(i), find(j))
        for j in range(i):
            if not bags[i] and rows[j][1] == text:
                up[max(find(i), find(j))] = min(find(i), find(j))
    groups = {}
    for i, (doc_id, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(doc_id)
    return {d: min(g) for g in groups.values() for d in g}, near


def test_near_duplicates_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want, near = brute_classes([(r.doc_id, r.text) for r in docs.select("doc_id", "text").orderBy("doc_id").collect()], 0.8)
    got = {r.doc_id: r.class_id for r in near_dups.classes(docs).collect()}
    assert len(near) > 50 and sum(got[a] == got[b] for a, b in near) >= 0.98 * len(near)
    assert all(want[d] == want[c] for d, c in got.items())


def test_near_duplicates_at_the_threshold(spark):
    """A crowd around one passage, pairwise between 0.5 and 1: nothing is joined that brute force leaves apart, 0.98 of the rest is."""
    rng = np.random.default_rng(11)
    passage, rows = [f"p{n}" for n in range(150)], []
    for k in range(120):
        words = list(passage)
        for at in rng.choice(150, int(rng.integers(1, 7)), replace=False):
            words[at] = f"c{k}x{at}"
        rows.append((k, " ".join(words)))
    want, near = brute_classes(rows, 0.8)
    got = {r.doc_id: r.class_id for r in near_dups.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(want[d] == want[c] for d, c in got.items())
    assert sum(got[a] == got[b] for a, b in near) >= 0.98 * len(near)


def test_blocks_of_a_bucket_meet(spark, monkeypatch):
    """With blocks of seven members the crowd falls into the same classes."""
    monkeypatch.setattr(near_dups, "BLOCK", 7)
    test_near_duplicates_in_a_crowd(spark)
    test_near_duplicates_at_the_threshold(spark)


def test_levels_behind_a_call_settled_last(spark):
    """P has two waits that settle at once; C waits for P alone, and nothing else keeps the rounds going."""
    rows = spark.createDataFrame([("a", None), ("b", None), ("p", ["a", "b"]), ("c", ["p"])], "call_id string, after array<string>")
    assert {r.call_id: r.level for r in tool_calls.levels(rows).collect()} == {"a": 0, "b": 0, "p": 1, "c": 2}


def test_media_round_trip(odd, none, spark):
    from ledgerlens.llm.common import shared_dir

    for data in (b"", b"a", b"x" * 576, bytes(range(256)) * 9):
        payload = media.pad(data)
        assert len(payload) % 576 == 0 and payload.startswith(data) and media.decode(media.encode(payload)) == payload
    rows = media.store(odd, shared_dir(spark, "media"))
    found = media.read(media.catalogue(rows)).collect()
    assert rows.count() == odd.count() and len(found) == rows.select("digest").distinct().count()
    assert all(r.digest == r.payload_sha256 and r.width == 576 and r.depth == 8 for r in found)
    assert media.store(none, shared_dir(spark, "media")).count() == 0


def test_language_of_odd_inputs(odd, none):
    model = language.train([np.array([1, 2, 3]), np.array([7, 8])], ["aa", "bb"])
    got = {(r.doc_id, r.lang_pred) for r in language.predict(odd, model).collect()}
    assert {(0, "und"), (1, "und"), (2, "und")} <= got and len(got) >= 9
    assert language.predict(none, model).count() == 0 and language.predict(odd, language.Model()).where("lang_pred != 'und'").count() == 0
    assert language.keep_known(odd, model).columns == odd.columns and language.keep_known(odd, model).count() == odd.count() - 3


def test_held_out_toxicity(spark):
    rng = np.random.default_rng(2)
    texts = [" ".join(f"w{n}" for n in rng.integers(0, 300, 60)) + (" you idiot" if i % 3 == 0 else "") for i in range(600)]
    y = np.array([i % 3 == 0 for i in range(600)]).astype(int)
    model = toxicity.train(pa.chunked_array([texts[:400]]), y[:400])
    docs = spark.createDataFrame([(i, texts[i]) for i in range(400, 600)] + [(999, None)], "doc_id long, text string")
    got = {r.doc_id: r.predicted for r in toxicity.score(docs, model).collect()}
    assert np.mean([got[i] == y[i] for i in range(400, 600)]) > 0.97
    assert toxicity.keep_clean(docs, model).columns == docs.columns


def fuzzy_ends(part, text):
    """Edits of ``part`` against the best stretch of text that ends at each place, by dynamic programming over all of them."""
    before = [0] * (len(text) + 1)
    for i, c in enumerate(part, 1):
        now = [i]
        for j, d in enumerate(text, 1):
            now.append(min(before[j] + 1, now[j - 1] + 1, before[j - 1] + (c != d)))
        before = now
    return before


def least_edits(marked, text):
    """The fewest edits with which a notice stands in a text, its words in braces unedited; None if nowhere."""
    if "{" not in marked:
        return min(fuzzy_ends(marked, text))
    left, word, right = (x.strip() for x in re.fullmatch(r"([^{]*)\{([^}]*)\}(.*)", marked).groups())
    word, found = f" {word} ", []
    for m in re.finditer(f"(?={re.escape(word)})", text):
        at = m.start()
        found.append(fuzzy_ends(left, text[:at])[-1] + fuzzy_ends(right[::-1], text[at + len(word) :][::-1])[-1])
    return min(found, default=None)


def test_notices_against_a_search_of_every_stretch():
    import random

    rng, finder = random.Random(5), notices.Finder()
    letters = "abcdefghijklmnopqrstuvwxyz     é"
    checked = 0
    for round_ in range(400):
        words = " ".join("".join(rng.choice(letters[:26]) for _ in range(rng.randint(1, 8))) for _ in range(rng.randint(0, 12)))
        parts = [f" {words} "]
        for _ in range(rng.randint(1, 2)):
            notice = list(rng.choice(list(notices.NOTICES.values())).replace("{", "").replace("}", ""))
            for _ in range(rng.choice([0, 1, 2, 3, 4, 6, 9])):
                at, kind = rng.randrange(len(notice)), rng.randrange(3)
                notice[at : at + 1] = [] if kind == 0 else [rng.choice(letters)] if kind == 1 else [notice[at], rng.choice(letters)]
            parts.append("".join(notice) + " ")
        text = f" {' '.join(''.join(parts).split())} "
        got = {}
        for h in finder.find(text):
            got[h.label] = min(got.get(h.label, 99), h.edits)
        for label, marked in notices.NOTICES.items():
            least = least_edits(marked, text)
            assert got.get(label) == (least if least is not None and least <= finder.notices[label].edits else None), (label, text)
            checked += label in got
    assert checked > 200


def test_no_licence_is_taken_for_another():
    finder = notices.Finder()
    for label, marked in notices.NOTICES.items():
        assert {h.label for h in finder.find(f" x {marked.replace('{', '').replace('}', '')} y ")} == {label}
    assert not finder.find(" licensed under cc by nd ") and not finder.find(" released under the isc license ")


def test_notices(odd, none):
    finder = notices.Finder()
    joined = " some text relased under the mit license end "
    hit = [h for h in finder.find(joined) if h.label == "mit"][0]
    assert hit.edits == 1 and joined[hit.start : hit.end].startswith("relased")
    many = " all rights reserved" * 5_000 + " "
    assert len(finder.find(many)) == 5_000
    docs = odd.sparkSession.createDataFrame([(1, "X. All Rights Reserved, all rights reserved CC-BY"), (2, None), (3, "é Released under thé MIT license.")], "doc_id long, text string")
    got = {r.doc_id: r for r in notices.scan(docs).collect()}
    assert (got[1].n_words, got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels, got[1].score) == (9, 3, 1, 7, "cc-by,reserved", 1.0)
    assert (got[2].n_words, got[2].n_base, got[2].first_word, got[2].labels, got[2].score, got[2].spans) == (0, 0, None, "", 0.0, [])
    assert [(s.label, s.start, s.end, s.edits) for s in got[3].spans] == [("mit", 3, 33, 1)]
    assert notices.scan(odd).count() == odd.count() and notices.scan(none).count() == 0


def test_base_phrases_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r for r in notices.scan(docs).collect()}
    for r in docs.select("doc_id", "text").collect():
        w, at = WORD.findall(lower(r.text)), []
        labels = set()
        for phrase, label in notices.BASE.items():
            p = phrase.split()
            here = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
            at += here
            labels |= {label} if here else set()
        g = got[r.doc_id]
        assert (g.n_words, g.n_base, g.first_word, g.last_word, g.base_labels) == (len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels)))


def test_media_columns_against_plain_reading(odd, none, spark):
    import struct
    from collections import Counter

    from ledgerlens.llm.common import shared_dir

    def plain(text):
        data = (text or "").encode()
        payload = data + b"\xff" * (-len(data) % 576 if data else 576)
        rows = b"".join(b"\0" + payload[i : i + 576] for i in range(0, len(payload), 576))
        chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
        stored = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 576, len(payload) // 576, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows, 1)) + chunk(b"IEND", b"")
        return len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), f"{sum(payload) / len(payload):.3f}"

    rows = media.media_columns(odd, shared_dir(spark, "media")).collect()
    got = Counter((str(r.doc_id), r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256, r.feature.split("-")[1]) for r in rows)
    assert got == Counter((str(r.doc_id), *plain(r.text)) for r in odd.collect())
    assert len({(r.payload_sha256, r.feature, r.media_sha256) for r in rows}) == len({r.payload_sha256 for r in rows})
    assert media.media_columns(none, shared_dir(spark, "media")).count() == 0


def test_pipeline_stages_keep_columns(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "toxicity", "near_duplicates", "decontamination", "packing"]
    for _, stage in corpus_pipeline.STAGES[:2]:
        assert stage(spark, docs, "/root/testdata/sf0.001").columns == docs.columns


def test_pipeline_on_odd_inputs(spark, odd, tmp_path):
    """All stages in a chain, over nulls, empties, repeats, clashing columns, and an empty table."""
    import corpus_pipeline

    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    base = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", F.col("source").alias("node"), F.lit(1.0).alias("score"))
    extra = spark.createDataFrame([(900_001, f"the and of {item} with that", "en", "n", 1.0), (900_002, None, None, None, None), (None, "the and of these were", None, None, None)], "doc_id long, text string, lang string, node string, score double")
    docs = base.union(base.limit(5)).union(odd.select(F.col("doc_id") + 800_000, "text", "lang", "node", "score")).union(extra)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.read.parquet("/root/testdata/sf0.001/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    for start in (docs, docs.where("false")):
        start.write.mode("overwrite").parquet(f"{tmp_path}/start")
        now, ids = spark.read.parquet(f"{tmp_path}/start"), {}
        for name, stage in corpus_pipeline.STAGES:
            now_path = f"{tmp_path}/{name}-{start is docs}"
            found = stage(spark, now, str(tmp_path))
            assert name == "packing" or found.columns == docs.columns
            found.write.parquet(now_path)
            now = spark.read.parquet(now_path)
            ids[name] = [r.doc_id for r in now.select("doc_id").distinct().collect()]
        if start is docs:
            assert 900_002 not in ids["language"] and 800_001 not in ids["language"] and 800_002 not in ids["language"] and None in ids["language"]
            assert 900_001 in ids["near_duplicates"] and 900_001 not in ids["decontamination"]
            assert (800_005 in ids["near_duplicates"]) + (800_006 in ids["near_duplicates"]) <= 1
            assert sorted(map(str, ids["packing"])) == sorted(map(str, ids["decontamination"])) and len(ids["packing"]) > 100
        else:
            assert not any(ids.values())
