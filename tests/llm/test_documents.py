import hashlib
import random
import re
import struct
import zlib
from collections import defaultdict
from html import unescape

import numpy as np
import pytest
from pyspark.sql import functions as F

from gatewarden.llm import chat, fingerprints, html_text, mixing, packing, quality, token_files, toxicity
from gatewarden.llm.queries import ORACLES, QUERIES
from gatewarden.llm.shared import Scratch


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, data, check_same, name):
    check_same(QUERIES[name](spark, data), ORACLES[name])


def test_quality_cases(spark):
    rows = [(1, None), (1, None), (2, ""), (3, "a b c d e a b c d e"), (4, "x\ny\nx\n\n x"), (None, "é# $"), (5, "w " * 50000)]
    led = quality.ledger(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {(r["doc_id"], r["n_words"]): r for r in led.collect()}
    assert got[(3, 10)]["n_repeat_words"] == 10 and got[(4, 4)]["n_dup_lines"] == 1 and got[(None, 2)]["n_symbols"] == 2 and got[(5, 50000)]["n_repeat_words"] == 50000
    assert got[(1, 0)]["failed_bits"] & 1 and quality.kept(led).count() == 0
    a = {r["rule"]: r for r in quality.ablations(led).collect()}
    assert a["too_few_words"]["n_failed"] == 5 and a["too_few_words"]["kept_without"] >= a["too_few_words"]["kept"]
    assert quality.ablations(led.where("false")).first()["n_docs"] == 0


def brute_targets(sizes, weights=(5, 2, 1)):
    names = sorted(sizes, key=lambda s: (s is None, s))
    w, total = {s: weights[i % 3] for i, s in enumerate(names)}, 1.5 * sum(sizes.values())
    fixed = {}
    while True:
        rest = [s for s in names if s not in fixed]
        level = (total - sum(fixed.values())) / max(1e-9, sum(w[s] for s in rest))
        over = [s for s in rest if level * w[s] > 2 * sizes[s]]
        if not over:
            return {**fixed, **{s: level * w[s] for s in rest}}
        fixed |= {s: 2.0 * sizes[s] for s in over}


def check_mix(df, rows):
    got = [tuple(r) for r in df.select("source", "size", "source_size", "target", "taken").collect()]
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want, took = brute_targets(sizes), defaultdict(int)
    assert len(got) == len(rows)
    for s, size, all_, target, taken in got:
        assert all_ == sizes[s] and target == pytest.approx(want[s]) and 0 <= taken <= 2 * size
        took[s] += taken
    assert all(abs(took[s] - want[s]) <= 0.5 + 1e-6 for s in sizes)


def test_mix(spark, data):
    df = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "source")
    out = mixing.mixed(df)
    check_mix(out, [tuple(r) for r in df.collect()])
    key = lambda d: sorted(tuple(r) for r in d.select("doc_id", "taken").collect())
    assert key(out) == key(mixing.mixed(df.repartition(5)))


def test_mix_cases(spark):
    rows = [(1, "a b c", "x"), (1, "a b c", "x"), (2, None, "x"), (3, "", "y"), (None, "q r s t", None), (4, "one two", "z"), (5, "k " * 5000, "y")]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, source string, target double")
    check_mix(mixing.mixed(df), rows)
    assert mixing.mixed(df.where("false")).count() == 0


def check_pack(df, rows, tokenizer):
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in df.collect():
        pieces[r["doc_id"]].append(r)
        windows[r["sequence_id"]].append(r)
    ids = {d: tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for d, t in rows}
    assert set(pieces) == set(ids)
    for d, want in ids.items():
        at = 0
        for r in sorted(pieces[d], key=lambda r: r["start"]):
            part = want[at : at + r["length"]]
            assert r["start"] == at and r["doc_tokens"] == len(want) and r["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
            at += r["length"]
        assert at == len(want)
    for rs in windows.values():
        at = 0
        for r in sorted(rs, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 4096
    return sum(map(len, ids.values())) / (4096 * len(windows)) if windows else 1


def test_pack(spark, data, tokenizer):
    df = spark.read.parquet(f"{data}/documents.parquet")
    assert check_pack(packing.pack(df), [tuple(r) for r in df.select("doc_id", "text").collect()], tokenizer) > 0.9


def test_pack_cases(spark, tokenizer):
    rows = [(1, "a b c", "x"), (2, None, "x"), (3, "", "y"), (4, "Don't  STOP <|endoftext|> é\x1cé 123 ...", None), (5, "word" * 20000, "y"), (6, "\x1d\x85 a　b İstanbul ΣΑΣ", "y"), (None, "n", "x")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, source string, start int")
    check_pack(packing.pack(df), [r[:2] for r in rows], tokenizer)
    assert packing.pack(df.where("false")).count() == 0


def mixture(df, block):
    """Source of each full block in the order of the windows, and the deficits given with them."""
    rows = df.where("deficit is not null").orderBy("sequence_id", "offset").collect()
    at = {(r["sequence_id"], r["offset"] // block): (r["source"], r["deficit"]) for r in rows}
    return [at[k] for k in sorted(at)]


@pytest.mark.parametrize("texts", [{"a": 40, "b": 40, "c": 40}, {"a": 300, "b": 20, None: 3}])
def test_pack_mixture(spark, texts):
    r = random.Random(6)
    rows = [(i, s, " ".join(r.choice(("the", "of", "word")) for _ in range(r.randrange(200)))) for i, s in enumerate(s for s, n in texts.items() for _ in range(n))]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(3)
    for weights in (None, {"a": 1, "b": 3}):
        order = mixture(packing.pack(df, window=128, block=16, weights=weights), 16)
        n = {s: sum(x == s for x, _ in order) for s in texts}
        goal = weights or n
        share = {s: goal.get(s, 0) / sum(goal.values()) for s in texts}
        sent, worst = dict.fromkeys(texts, 0), 0
        for k, (s, deficit) in enumerate(order):
            sent[s] += 1
            assert deficit == pytest.approx((share[s] * (k + 1) - sent[s]) * 16)
            if all(sent[x] < n[x] for x in goal):  # no queue has run dry
                worst = max(worst, *(abs(share[x] * (k + 1) - sent[x]) for x in texts))
        assert worst <= len(texts) / 2 + 1
        if weights and None in texts:
            assert [s for s, _ in order][-n[None] :] == [None] * n[None]


def test_window_mixture(spark, data):
    df = packing.pack(spark.read.parquet(f"{data}/documents.parquet"))
    got = packing.window_mixture(df)
    assert got.agg(F.sum("tokens")).first()[0] == df.agg(F.sum("length")).first()[0]
    n = df.select("source").distinct().count()
    assert got.agg(F.max(F.abs("deficit"))).first()[0] <= (n / 2 + 1) * packing.BLOCK


def test_token_counts(spark, data, tokenizer):
    got = {r["doc_id"]: r["n_tokens"] for r in QUERIES["op3_token_counts"](spark, data).collect()}
    rows = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    assert got == {r[0]: len(tokenizer.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in rows}


def brute_scan(ids, end):
    out, start = [], 0
    for i, x in enumerate(ids):
        if x == end:
            out.append((start, i + 1 - start, True))
            start = i + 1
    return out + ([(start, len(ids) - start, False)] if start < len(ids) else [])


def test_token_scan(spark, tmp_path, monkeypatch):
    r = random.Random(5)
    streams = [[5, 5, 5, 5, 5, 2, 2, 7, 2, 9, 9, 9, 9], [], [2], [7] * 40, [2] * 40, [r.choice((2, 3, 3, 3, 70000)) for _ in range(500)], [3] * 99 + [2]]
    monkeypatch.setattr(token_files, "CHUNK", 3)
    for width in (2, 4):
        rows = []
        for i, ids in enumerate(streams):
            f = tmp_path / f"{width}-{i}.bin"
            f.write_bytes(np.array([x if width == 4 else min(x, 60000) for x in ids], f"<u{width}").tobytes() + b"\x02" * (i % 2 and width - 1))
            rows.append((f"file://{f}", f.stat().st_size))
        files = spark.createDataFrame(rows, "file string, n_bytes long")
        for block in (1, 4, 7, 1 << 18):
            got = sorted(tuple(r) for r in token_files.scan(files, Scratch(spark, "scan"), 2, width, block).collect())
            assert got == sorted((f, k, *x) for (f, _), ids in zip(rows, streams) for k, x in enumerate(brute_scan(ids, 2)))
        assert token_files.scan(files.where("false"), Scratch(spark, "scan"), 2, width).count() == 0


def test_token_files(spark, tokenizer):
    rows = [(None, None), (1, "<|endoftext|> a"), (1, ""), (2, "b " * 40000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, file int")
    scratch = Scratch(spark, "t")
    files, names = token_files.write_files(df, scratch)
    got = token_files.scan(files, scratch, block=77)
    assert got.count() == got.where("closed").count() == 4
    assert sorted((str(r[0]), r[1]) for r in got.join(names, ["file", "ordinal"]).select("doc_id", "n_tokens").collect())[0] == ("1", 1)
    assert token_files.write_files(df.where("false"), Scratch(spark, "e"))[1].count() == 0
    with pytest.raises(Exception, match="does not fit"):
        token_files.write_files(df, Scratch(spark, "w"), end_id=70000)


def test_fingerprints(spark, data):
    df = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    check_fingerprints(fingerprints.compared(df), [tuple(r) for r in df.collect()], 0.9)


def check_fingerprints(df, rows, better):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want = []
    for i, (d, t) in enumerate(rows):
        t, nxt = t or "", rows[(i + 1) % len(rows)][1] or ""
        q = len(t) // 4
        want.append((-1 if d is None else d, len(t), hashlib.sha256((t[: len(t) - q] + nxt[:q]).encode()).hexdigest()))
    got = df.collect()
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == sorted(want)
    assert all(0 <= r[c] <= 1 for r in got for c in ("near_edited", "near_next"))
    by = defaultdict(set)
    text = defaultdict(list)
    for d, t in rows:
        text[d].append(t or "")
    for r in got:
        if len(text[r["doc_id"]]) == 1:
            by[text[r["doc_id"]][0]].add(r["fingerprint"])
    assert all(len(v) == 1 for v in by.values())
    assert sum(r["near_edited"] > r["near_next"] for r in got) >= better * len(got)


def test_fingerprint_cases(spark):
    rows = [(1, "a b c"), (2, None), (5000, ""), (3000000, "the dog is of cat and more words here"), (None, "null id"), (7, "x"), (7, "x"), (8, "the word " * 20000)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, next string")
    check_fingerprints(fingerprints.compared(df), rows, 0)
    assert fingerprints.compared(df.where("false")).count() == 0


PAGE = """<html><head><title>T</title></head><body class="home"><header><h1>Site</h1></header><div id="cookie-notice">We use cookies</div><nav><a href=x>Home</a></nav>
<div class="wrap"><div class="sidebar"><p>Side text that is long enough to be seen by everyone here</p></div><div class="content post-12"><h2>Title &amp; more</h2><p>First  para&nbsp;graph <a href=y>link</a> text.
<p>Second<br>line <b>bold</b></p><form>Subscribe <input></form><ul><li>One<li>Two</ul><div class="share">Share</div><!-- x --><script>var a="<p>no</p>";</script></div><section id="comments"><p>Reader says hello hello hello</p></section></div><footer>c</footer></body></html>"""


def test_pages(spark, data):
    rows = spark.read.parquet(f"{data}/pages.parquet").collect()
    got = {r["page_id"]: r for r in QUERIES["op6_html_extraction"](spark, data).collect()}
    assert len(got) == len(rows)
    for r in rows:
        inner = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        want = "\n".join(w for w in (re.sub(r"\s+", " ", unescape(re.sub(r"<[^>]*>", "", p))).strip() for p in re.split(r"</?(?:p|h1|article)>", inner)) if w)
        assert got[r["page_id"]]["text"] == want and got[r["page_id"]]["n_chars"] == len(want)


def test_page_cases(spark):
    text = "Title & more\nFirst para graph link text.\nSecond line bold\nOne\nTwo"
    rows = [(1, "http://h/1", PAGE), (2, "HTTP://H:80/2", PAGE.replace("post-12", "post-7")), (3, None, None), (4, "", "<p>a<p>b"), (None, "x", "plain"), (5, "http://h/5", "<div><p>" + "long " * 50000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, path int")
    got = {r["page_id"]: r["text"] for r in html_text.extract(df).collect()}
    assert got[1] == got[2] == text and got[3] == "" and got[4] == "a\nb" and got[None] == "plain" and len(got[5]) == 249999
    assert html_text.extract(df.where("false")).count() == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            old, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, old + (x != y))
    return row[-1]


def test_automaton_equals_edit_distance():
    r = random.Random(8)
    word = lambda n: "".join(r.choice("abc") for _ in range(n))
    for _ in range(30):
        words, stems = ({word(r.randrange(2, 9)): r.randrange(3) for _ in range(6)} for _ in range(2))
        lexicon = toxicity.Lexicon(words, stems)
        for _ in range(150):
            w = word(r.randrange(0, 12))
            best = [(distance(w, t), 0, t) for t, k in words.items() if distance(w, t) <= k]
            best += [(e, 1, t) for t, k in stems.items() if (e := min(distance(w[:i], t) for i in range(len(w) + 1))) <= k and w]
            got = lexicon.meet(w)
            if not best:
                assert got is None, (w, words, stems)
            else:
                assert (got[0], got[2]) == (min(best)[0], toxicity.Lexicon.WORD if min(best)[1] == 0 else toxicity.Lexicon.STEM) and (got[0], got[2] - 1, got[1]) in best


def test_disguised_words():
    scan = toxicity.Scanner({w: toxicity.edits_for(len(w)) for w in toxicity.BASE}, {})
    edits = {w: scan.verdict(w) and scan.verdict(w)[3] for w in ("idiot,", "idiott", "looser", "1diot", "m0ron", "worthles", "wurthles", "i.d.i.o.t", "you-moron", "birth", "2024-01-13", "good", "«idiot»")}
    assert edits == {"idiot,": 0, "idiott": 1, "looser": 1, "1diot": 1, "m0ron": 1, "worthles": 1, "wurthles": 2, "i.d.i.o.t": 0, "you-moron": 0, "birth": None, "2024-01-13": None, "good": None, "«idiot»": 0}


def test_toxicity(spark):
    rows = [(1, "you stupid m0ron"), (2, None), (3, ""), (None, 'he said "stupid idiot" yesterday'), (4, "good day " * 30000), (4, "good day")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, score int")
    model = {w: toxicity.edits_for(len(w)) for w in toxicity.BASE}, {}, toxicity.DEFAULT
    got = [(r["doc_id"], r["score"]) for r in toxicity.score(df, model).collect()]
    by = dict(got)
    assert len(got) == 6 and by[1] > 0.9 and by[2] == by[3] == by[4] and by[4] < by[None] < 0.5
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.train(df, empty)[1] == {} and toxicity.score(df.where("false"), toxicity.train(df, empty)).count() == 0
    assert toxicity.train(df.where("false"), spark.createDataFrame([(1, 1, 1), (None, 0, 0)], "doc_id long, quality int, toxic int"))[1] == {}


def test_edits_that_clean_texts_hold_are_not_allowed(spark):
    r = random.Random(9)
    filler = lambda: " ".join(f"{r.choice('bdfgkmnprst')}{r.randrange(10**6)}" for _ in range(12))
    rows = [(i, f"{filler()} {'you clown' if i % 2 else r.choice(('the crown', 'a closer table'))} {filler()}") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0, i % 2) for i, _ in rows] * 2, "doc_id long, quality int, toxic int")
    words, _, weights = toxicity.train(df, labels)
    assert words["clown"] == words["loser"] == 0 and words["moron"] == 1
    new = spark.createDataFrame([(1, "what a clown he is"), (2, "the crown of it"), (3, "you are a mormon idiott")], "doc_id long, text string")
    by = {x["doc_id"]: x["score"] for x in toxicity.score(new, (words, {}, weights)).collect()}
    assert by[1] > 0.7 and by[2] < 0.3


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.1"
    r = QUERIES["op1_toxicity"](spark, d).where("held_out").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id")
    hit, found, toxic = r.agg(F.count_if((F.col("predicted") == 1) & (F.col("toxic") == 1)), F.sum("predicted"), F.sum("toxic")).first()
    assert hit / found > 0.95 and hit / toxic > 0.85


def test_chat(spark):
    call = lambda *c: '{"tool_calls":[' + ",".join(c) + "]}"
    rows = [
        (1, 0, "assistant", call('{"id":"a","name":"f","arguments":"{\\"x\\":1}"}', '{"id":"b","name":"f","arguments":{"x":{"$ref":"a"}}}')), (1, 1, "tool", '{"tool_call_id":"a","content":"ok"}'),
        (1, 2, "tool", '{"tool_call_id":"zz","content":1}'), (1, 3, "user", None), (2, 0, "assistant", call('{"id":"p","name":"g","arguments":{"y":{"$ref":"p"}}}')), (2, 1, "tool", '{"tool_call_id":"p","content":"c"}'), (None, None, None, "{bad"),
    ]
    df = spark.createDataFrame([(*r, True) for r in rows], "conv_id long, turn long, role string, text string, valid boolean")
    schema = {"f": {"type": "object", "required": ["x"], "properties": {"x": {"type": "integer"}}}}
    got = {(r["conv_id"], r["turn"], r["call_id"]): (r["kind"], r["valid"], r["linked"], r["level"]) for r in chat.format_chats(df, schema).collect()}
    assert got == {
        (1, 0, "a"): ("call", True, True, 0), (1, 0, "b"): ("call", False, False, 2), (1, 1, "a"): ("result", None, True, 1), (1, 2, "zz"): ("result", None, False, 0), (1, 3, None): ("text", None, None, 0),
        (2, 0, "p"): ("call", False, True, None), (2, 1, "p"): ("result", None, True, None), (None, None, None): ("text", None, None, 0),
    }
    assert chat.format_chats(df.where("false")).count() == 0
