"""The training-data operators against brute force, round trips and held-out labels."""

from __future__ import annotations

import hashlib
import html as html_lib
import json
import random
import re
import zlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from pathloom.llm import chat, classifier, html, idstore, media, mixing, packing, queries, rules, secrets, similar, simhash, tokens
from pathloom.llm.common import fresh_path

DOC = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def table(spark, texts, sources=None):
    rows = [(i, t, "en", (sources or ["a", "b", None])[i % len(sources or "abc")], len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC)


def as_sf(tmp_path, **tables):
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


ODD = [None, "", " ", "one", "one two", "naïve café – “quote” 漢字 　x", "a" * 5000, "w " * 3000, "tab\tline\n\nline\r\nx", "\x85\xa0 z 's 'll don't I'm", "12 345 ½ ² a1b2 #$%^ --- 😀😀", "</s><|end|> [INST]", "same text here", "same text here"]


def clashing(df):
    """Further columns with names that the operators use themselves."""
    for name in ("spans", "base", "open", "fp", "component_id", "rank", "at", "size", "kept", "first", "block", "ids", "media", "type", "embedded", "_k", "rest"):
        df = df.withColumn(name, F.lit(1))
    return df


# -- 1 -------------------------------------------------------------------------------------------
def test_chat_parts_and_round_trip(spark):
    part = lambda kind, text=None, **k: dict(kind=kind, text=text, ref=k.get("ref"), width=k.get("width"), height=k.get("height"), seconds=k.get("seconds"), pages=k.get("pages"))
    rows = [
        (1, 0, "user", [part("text", "see <|image|> "), part("image", ref="i.png", width=28, height=15), part("audio", ref="a.wav", seconds=2.0)]),
        (1, 1, "assistant", [part(None, "␛l </s>"), part("document", ref="d.pdf", pages=2)]),
        (2, 0, None, None),
        (None, 0, "assistant", [part("text", None)]),
    ]
    made = chat.read_chats(chat.format_chats(spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat.PART}>")))
    got = {r.conv_id: r for r in made.collect()}
    assert [(a.kind, a.ref, a.tokens) for a in got[1].attachments] == [("image", "i.png", 4), ("audio", "a.wav", 50), ("document", "d.pdf", 1024)]
    assert got[1].expanded_tokens == 1078
    assert len(re.findall(r"<\|(?:image|audio|document)\|>", got[1].formatted)) == 3
    assert got[1].turns[0].text.startswith("see <|image|> ") and got[1].turns[1].text.startswith("␛l </s>")
    assert got[2].turns[0].role == "" and got[None].loss_text == ""


def test_op1_brute_force(spark, sf_dir):
    turns = defaultdict(list)
    for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect():
        turns[r.conv_id].append((r.turn, r.role or "", r.text or ""))
    turns[-1] = [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]
    got = {r.conv_id: r for r in chat.op1(spark, sf_dir).collect()}
    assert set(got) == set(turns)
    for k, rows in turns.items():
        rows.sort()
        loss = "".join(t for _, r, t in rows if r == "assistant")
        assert got[k].n_turns == len(rows) and got[k].loss_chars == len(loss)
        assert got[k].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in rows).encode()).hexdigest()
        assert got[k].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def test_op1_odd_conversations_equal_the_sql(spark, tmp_path):
    """Ties, repeated rows, nulls, control strings and clashing columns."""
    import duckdb

    rows = [(1, 0, "user", "b"), (1, 0, "user", "</s>"), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, "assistant", "first"), (1, 1, "assistant", None), (1, 1, "assistant", ""), (2, 0, None, "<|turn|>x<|end|>\n"), (2, 1, "assistant", "␛e [INST]" * 300), (3, 5, "assistant", "😀 é"), (3, 5, "assistant", "<|im_end|>")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"body": F.lit(1), "parts": F.lit(2), "start": F.lit(3), "segment": F.lit(4)})
    sf = as_sf(tmp_path, conversations=df)
    duckdb.execute(f"CREATE OR REPLACE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet/*.parquet'")
    found = duckdb.execute(chat.OP1_SQL)
    names = [d[0] for d in found.description]
    want = sorted(tuple(r) for r in found.fetchall())
    assert sorted(tuple(r[n] for n in names) for r in chat.op1(spark, sf).collect()) == want


# -- 2 -------------------------------------------------------------------------------------------
def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, out, open_ = sum(sizes.values()), {}, set(names)
    while open_:
        left = total - sum(out.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * sizes[s]]
        if not over:
            return out | share
        for s in over:
            out[s] = 3 * sizes[s]
            open_.discard(s)
    return out


def test_op2(spark, sf_dir, docs):
    rows = mixing.op2(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    sizes = Counter()
    for d in docs.values():
        sizes[d.source] += len(WORD.findall(d.text or ""))
    want, taken = brute_targets(dict(sizes)), Counter()
    for r in rows:
        source = docs[r.doc_id].source
        assert r.size == len(WORD.findall(docs[r.doc_id].text or "")) and r.source_size == sizes[source]
        assert r.target == pytest.approx(want[source]) and 0 <= r.taken <= 3 * r.size
        taken[source] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= 33
    assert sorted(rows) == sorted(mixing.op2(spark, sf_dir).collect())


def test_mix_caps_small_sources(spark, tmp_path):
    made = table(spark, ["w " * 10] + ["x " * 1000] * 4, ["a", "b", "b", "b", "b"])
    got = {r.doc_id: r for r in mixing.op2(spark, as_sf(tmp_path, documents=made)).collect()}
    assert got[0].target == 30 and got[0].taken <= 30 and got[1].target == 3980


def test_remixed_words_equal_taken(spark, docs, sf_dir):
    docs_df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = {r.doc_id: r.taken for r in mixing.op2(spark, sf_dir).collect()}
    got = Counter()
    for r in mixing.remixed(docs_df).collect():
        got[r.doc_id] += len(WORD.findall(r.text))
        assert r.n_chars == len(r.text)
    assert {k: v for k, v in want.items() if v} == dict(got)


@pytest.mark.parametrize("n", [1, 2, 7, 64, 1000])
def test_permutation(spark, n):
    made = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(3)).alias("p"))
    assert sorted(r.p for r in made.collect()) == list(range(n))


# -- 3 -------------------------------------------------------------------------------------------
def brute_fingerprint(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, radius=3):
    parent = {k: k for k in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(fps)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= radius:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {k: find(k) for k in ids}


def test_op3(spark, sf_dir, docs):
    fps = {k: brute_fingerprint(d.text) for k, d in docs.items()}
    want = brute_components(fps)
    got = simhash.op3(spark, sf_dir).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: r.fingerprint for r in got} == {k: f"{v:016x}" for k, v in fps.items()}


@pytest.mark.parametrize("tile", [4, 64, 1024])
def test_links_in_hot_buckets(spark, tile):
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(4)]
    fps = set(base)
    while len(fps) < 300:
        x = rng.choice(base) ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(1, 7)))
        fps.add(x & (2**64 - 1))
    ids = dict(enumerate(sorted(fps)))
    signed = [((v ^ (1 << 63)) - (1 << 63),) for v in fps]
    links = simhash.near_links(spark.createDataFrame(signed, "fp long"), 3, tile)
    root = {r.node & (2**64 - 1): r.root for r in simhash.components(links).collect()}
    want = brute_components(ids)
    groups = defaultdict(set)
    for i, r in want.items():
        groups[r].add(ids[i])
    made = defaultdict(set)
    for v in fps:
        made[root.get(v, ("alone", v))].add(v)
    assert {frozenset(g) for g in made.values()} == {frozenset(g) for g in groups.values()}


# -- 4 -------------------------------------------------------------------------------------------
ARTICLE = "The keeper of the lighthouse had been on the rock for a year, and the sea was all that he saw from the window in the evening."


def test_html_keeps_article_and_drops_the_rest():
    page = f"""<html><head><title>T</title><style>p{{}}</style></head><body><header><a href=/>Home</a></header>
    <nav><ul><li><a href=/a>One</a></li></ul></nav><div class="cookie-notice">We use cookies on this site and you agree to it.</div>
    <article><h1>A &amp; B</h1><p>{ARTICLE}</p><p>{ARTICLE}   &lt;x&gt;</p><script>var a = "<p>no</p>";</script><form><p>{ARTICLE}</p></form></article>
    <aside>{ARTICLE}</aside><div id="comments"><p>{ARTICLE}</p></div><footer>Copyright</footer></body></html>"""
    assert html.main_text(page) == f"A & B\n{ARTICLE}\n{ARTICLE} <x>"


@pytest.mark.parametrize("page", [None, "", "<", "<!--", "<p", "&amp", "<div" * 2000, "<p>" * 20000, "<a href='" + "x" * 100000, "<script>" * 500])
def test_html_odd_pages(page):
    assert isinstance(html.main_text(page), str)


def test_op4_rows(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = html.op4(spark, sf_dir).collect()
    assert sorted(r.page_id for r in got) == sorted(r.page_id for r in pages.collect())
    assert all(r.n_chars == len(r.text) and "  " not in r.text for r in got)
    assert sum(bool(r.text) for r in got) > 0.9 * len(got)


# -- 5, 7 ----------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    def load(name):
        made = Tokenizer.from_file(packing.vocabulary(name))
        made.encode_special_tokens = False
        return lambda t: made.encode(t or "", add_special_tokens=False).ids

    return {n: load(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json")}


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_library(library, name, docs):
    encoder = tokens.Encoder(packing.vocabulary(name))
    rng = random.Random(3)
    alphabets = ["abcXYZ 's't 12\n\t", "é ß ł ĳ 'll’ \xa0\x85½²", "漢字 かな　 Ω я ", "😀‍ 👍🏽 é İ ſ K  ", "<|>/[]s INST </s>!?..--", "".join(map(chr, range(1, 0x250)))]
    made = ["".join(rng.choice(a) for _ in range(rng.randrange(1, 60))) for a in alphabets for _ in range(300)]
    mixed = "".join(alphabets)
    made += ["".join(rng.choice(mixed) for _ in range(80)) for _ in range(500)]
    for text in [*ODD, *made, *(d.text for d in docs.values())]:
        assert np.frombuffer(encoder.encode(text), dtype="<u4").tolist() == library[name](text), repr(text)[:200]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_gives_ids_of_added_tokens(library, name):
    encoder, rng = tokens.Encoder(packing.vocabulary(name)), random.Random(6)
    parts = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endof", "text|>", " ", "\n", "a", "don't", "\u00e9", "\u0130", "e\u0301", "'s"]
    made = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 12))) for _ in range(1000)]
    for text in ["a <|endoftext|> b", "<|startoftext|>", *made]:
        assert np.frombuffer(encoder.encode(text), dtype="<u4").tolist() == library[name](text), repr(text)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_of_many_texts_equals_library(library, name, docs, monkeypatch):
    encoder, rng = tokens.Encoder(packing.vocabulary(name)), random.Random(8)
    plain = ["the", "The", "CAT", "caf\u00e9", "don't", "I'll", "x2", "\u6f22\u5b57", "e\u0301", "\u0130", "(a)", "..."]
    made = [rng.choice(["", " ", "\n"]) + "".join(rng.choice(plain) + rng.choice(["", "", *tokens.STOPS, ".,", "'s."]) + rng.choice([" ", " ", "\n", "\n\n"]) for _ in range(9)).rstrip(rng.choice(["", "\n", " \n"])) for _ in range(400)]
    odd = [rng.choice(plain) + x + rng.choice(plain) + "." for x in [*tokens.UNPLAIN, *tokens.NOT_WHITE, *map(chr, [0x85, 0xA0, 0x1680, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]), "\f", "<|endoftext|>", "<|startoftext|>", ".<|endoftext|>,"]]
    texts = [None, "", " ", "\n", "\n\n", ",", "a,", *ODD, *made, *odd, *(d.text for d in docs.values()), None]
    want = [library[name](t) for t in texts]
    for stretch, longest in ((4 << 20, 64 << 20), (200, 64 << 20), (4 << 20, 100)):
        monkeypatch.setattr(tokens, "STRETCH", stretch)
        monkeypatch.setattr(tokens, "LONG_TEXT", longest)
        got = list(encoder.encode_all(pa.array(["cut away", *texts], pa.string()).slice(1)))
        assert [np.frombuffer(x, dtype="<u4").tolist() for x in got] == want
    for few in ([], [None], [""], [" ", None]):
        assert [len(x) for x in encoder.encode_all(pa.array(few, pa.string()))] == [4 * len(library[name](t)) for t in few]


def test_op5_asks_for_a_word_once_a_stretch(library, monkeypatch):
    path, asked = packing.vocabulary("byte_bpe_50k.json"), Counter()
    encoder = tokens.Encoder(path)

    def make(piece):
        asked[piece] += 1
        return encoder.piece(piece)

    encoder.memo = tokens.Memo(make, most=1)  # remembers next to nothing: every question shows
    monkeypatch.setattr(tokens.Encoder, "_made", {path: encoder})
    monkeypatch.setattr(packing, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    words = [f"w{'abcdefghij'[i]}" for i in range(10)]
    texts = ["z " + ", ".join(random.Random(k).sample(words, 10)) + "." for k in range(100)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(100)), pa.array(["s"] * 100), pa.array(texts)], names=["doc_id", "source", "text"])
    (block,) = packing.tokenized_blocks(path, 0)(iter([batch]))
    assert np.frombuffer(block.column("ids")[0].as_py(), dtype="<u2").tolist() == [i for t in texts for i in [*library["byte_bpe_50k.json"](t), 0]]
    assert set(asked) >= {f" {w}" for w in words} and max(asked.values()) == 1


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def check_pieces(pieces, want, size=1024):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    assert set(by_doc) == set(want)
    for k, ps in by_doc.items():
        ps.sort(key=lambda p: p.start)
        assert [p.start for p in ps] == [sum(q.length for q in ps[:i]) for i in range(len(ps))]
        assert sum(p.length for p in ps) == len(want[k]) and all(p.doc_tokens == len(want[k]) for p in ps)
        assert all(p.ids_crc32 == crc(want[k][p.start : p.start + p.length]) for p in ps)
    padding = 0
    for ps in by_sequence.values():
        ps.sort(key=lambda p: p.offset)
        assert [p.offset for p in ps] == [sum(q.length for q in ps[:i]) for i in range(len(ps))]
        n = sum(p.length for p in ps)
        assert n <= size
        padding += 0 if n & (n - 1) == 0 else size - n
    assert padding == 0


def test_op5(spark, sf_dir, docs, library):
    want = {k: library["byte_bpe_50k.json"](d.text) + [0] for k, d in docs.items()}
    check_pieces(packing.op5(spark, sf_dir).collect(), want)


def test_packing_small_blocks_and_odd_texts(spark, library):
    rows = table(spark, ODD)
    want = {i: library["byte_bpe_50k.json"](t) + [0] for i, t in enumerate(ODD)}
    made = packing.pack(clashing(rows).drop("ids"), packing.vocabulary("byte_bpe_50k.json"), size=64, window_sequences=2, block=300).collect()
    check_pieces(made, want, 64)


def test_packing_holds_the_proportions(spark):
    rows = table(spark, ["alpha beta gamma delta " * 60] * 60, ["a", "a", "a", "b"])
    made = packing.pack(rows.coalesce(1), packing.vocabulary("byte_bpe_50k.json"), window_sequences=4).collect()
    window = defaultdict(Counter)
    for p in made:
        window[p.sequence_id // 4][p.source] += p.length
    whole = [w for w in window.values() if sum(w.values()) == 4096]
    assert whole and all(abs(w["a"] / 4096 - 0.75) < 0.01 for w in whole)


def test_packing_mixes_a_table_laid_out_by_source(spark, library):
    texts = [f"alpha beta gamma {i} " * (20 + i % 7) for i in range(400)]
    rows = table(spark, texts).withColumn("source", F.when(F.col("doc_id") < 200, "a").when(F.col("doc_id") < 300, "b")).orderBy("doc_id").repartitionByRange(8, "doc_id")
    want = {i: library["byte_bpe_50k.json"](t) + [0] for i, t in enumerate(texts)}
    total, sizes = sum(map(len, want.values())), Counter()
    for i, ids in want.items():
        sizes["a" if i < 200 else "b" if i < 300 else None] += len(ids)
    for weights, share in ((None, {s: n / total for s, n in sizes.items()}), ({"a": 1, "b": 3}, {"a": 0.25, "b": 0.75, None: 0})):
        made = packing.pack(rows, packing.vocabulary("byte_bpe_50k.json"), window_sequences=4, weights=weights, block=900).collect()
        check_pieces(made, want)
        window, by_sequence = defaultdict(Counter), defaultdict(set)
        for p in made:
            window[p.sequence_id // 4][p.source] += p.length
            by_sequence[p.sequence_id].add(p.source)
        lasting = min(int(sizes[s] / share[s]) for s in share if share[s]) // 4096  # windows until a source runs out
        assert lasting > 2 and all(abs(window[k][s] - 4096 * share[s]) < 40 for k in range(lasting) for s in share)
        assert all(len(by_sequence[q]) == sum(map(bool, share.values())) for q in range(4 * lasting))


def test_op7(spark, sf_dir, docs, library):
    got = {r.doc_id: r for r in idstore.op7(spark, sf_dir).collect()}
    at = 0
    for k in sorted(docs):
        ids = library["word_bpe_49k.json"](docs[k].text) + [1]
        assert (got[k].start, got[k].n_tokens, got[k].ids_crc32) == (at, len(ids), crc(ids))
        at += len(ids)
    assert len(got) == len(docs)


def test_store_rebuilds_and_shares_chunks(spark, library):
    rng = random.Random(5)
    passage = " ".join(rng.choice(["stone", "river", "lamp", "north", "glass"]) + str(rng.randrange(99)) for _ in range(3000))
    rows = table(spark, [passage, "before " + passage, passage, None, "x"])
    store, path = fresh_path(spark, "store"), packing.vocabulary("word_bpe_49k.json")
    idstore.write_store(rows, store, path)
    ids = {k: v.tolist() for k, v in idstore.rebuild(spark, store, path, [0, 1, 3]).items()}
    assert ids == {0: library["word_bpe_49k.json"](passage) + [1], 1: library["word_bpe_49k.json"]("before " + passage) + [1], 3: [1]}
    chunks, uses = idstore.read_chunks(spark, store).count(), sum(len(r.names) for r in idstore.read_recipes(spark, store).collect())
    assert chunks < 0.5 * uses


# -- 6 -------------------------------------------------------------------------------------------
def brute_base(text):
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        out.append((m.start(), 0, m.end(), "assign")) if len(m[2]) >= 8 else None
    for m in re.finditer(r"AKIA[A-Z0-9]+", text):
        out.append((m.start(), 1, m.end(), "access")) if len(m[0]) >= 16 else None
    for m in re.finditer(r"[0-9a-f]+", text):
        out.append((m.start(), 2, m.end(), "hex")) if len(m[0]) >= 32 else None
    return sorted(out)


def test_op6(spark, sf_dir, docs):
    for r in secrets.op6(spark, sf_dir).collect():
        base = brute_base(docs[r.doc_id].text or "")
        shown = ",".join(f"{k}:{s}:{e}" for s, _, e, k in base)
        kinds = Counter(k for *_, k in base)
        assert (r.n_assign, r.n_access, r.n_hex) == (kinds["assign"], kinds["access"], kinds["hex"])
        assert r.base_sha256 == hashlib.sha256(shown.encode()).hexdigest()
        assert set(filter(None, shown.split(","))) <= set(r.spans.split(","))


def test_random_strings_are_found_and_masked(spark):
    rng = random.Random(2)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    key = lambda: "".join(rng.choice(alphabet) for _ in range(40))
    prose = lambda: " ".join(rng.choice(["the", "river", "winter", "lantern", "of", "stone", "window", "and", "harbour"]) for _ in range(200))
    keys = [key() for _ in range(20)]
    texts = [f"{prose()} {keys[i]} {prose()}" if i < 20 else prose() for i in range(3000)]  # enough decoys for the 0.01 level
    rows = clashing(table(spark, [*texts, None, ""]))
    got = {r.doc_id: r for r in secrets.masked(rows).collect()}
    assert len(got) == 3002 and secrets.masked(rows).columns == rows.columns
    assert sum(k not in got[i].text for i, k in enumerate(keys)) >= 18
    assert all(got[i].text == texts[i] for i in range(20, 3000))


def test_random_strings_are_found_beside_a_hot_source_and_copies(spark):
    rng = random.Random(12)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    key = lambda n: "".join(rng.choice(alphabet) for _ in range(n - 2)) + "a1"
    prose = lambda: " ".join(rng.choice(["the", "river", "winter", "lantern", "of", "stone", "window", "and", "harbour"]) for _ in range(150))
    keys = [key(40) for _ in range(20)]
    texts = [f"{prose()} {k} {prose()}" for k in keys] + [prose() for _ in range(600)]
    lock = [" ".join("%064x" % rng.getrandbits(256) for _ in range(20)) for _ in range(200)]  # a hot source of hashes
    for more in ([], lock, [texts[0]] * 400):
        got = {r.doc_id: r for r in secrets.masked(table(spark, [*texts, *more])).collect()}
        assert sum(k not in got[i].text for i, k in enumerate(keys)) >= 18
        assert all(got[i].text == texts[i] for i in range(20, 620))


# -- 8 -------------------------------------------------------------------------------------------
def test_op8_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in classifier.op8(spark, sf).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 3 == 1) for k, r in got.items())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    held = [(got[r.doc_id].score, r.quality) for r in labels if got[r.doc_id].held_out]
    good, bad = [s for s, q in held if q], [s for s, q in held if not q]
    assert np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad]) > 0.8
    assert np.mean([(s >= 0.5) == q for s, q in held]) > 0.7


# -- 9 -------------------------------------------------------------------------------------------
def brute_rules(text):
    text = text or ""
    words = WORD.findall(text)
    grams = Counter(zip(words, words[1:], words[2:]))
    hit = {i + k for i, g in enumerate(zip(words, words[1:], words[2:])) if grams[g] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def test_op9(spark, sf_dir, docs):
    for r in rules.op9(spark, sf_dir).collect():
        want = brute_rules(docs[r.doc_id].text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r.base_failed and r.kept)


def test_rule_order_never_changes_the_verdict(spark):
    texts = [*ODD, *(" ".join(f"w{i * j % 97}" for j in range(80)) for i in range(40))]
    verdict = lambda order: [not any(x.rejects(rules.Document(t)) for x in order) for t in texts]
    assert verdict(rules.RULES) == verdict(rules.RULES[::-1])
    assert [r.name for r in rules.ordered([(x.name, 1.0, i / 10) for i, x in enumerate(rules.RULES)])] == [x.name for x in rules.RULES[::-1]]


def test_rules_are_ranked_by_what_earlier_ones_leave():
    figures = [(r.name, 1.0, 0.5) for r in rules.RULES]
    whom = {r.name: set() for r in rules.RULES} | {"symbols": {1, 2, 3, 4}, "shouting": {1, 2, 3}, "repetition": {7, 8}}
    assert [r.name for r in rules.ordered(figures, whom=whom)][:2] == ["symbols", "repetition"]
    texts = ["a b"] * 5 + [" ".join(f"w{i}" for i in range(200))] * 5
    assert {r.name for r in rules.planned(texts)} == {r.name for r in rules.RULES} and rules.planned(texts)[0].name == "few_words"


# -- 10 ------------------------------------------------------------------------------------------
def test_op10(spark, sf_dir, docs):
    by_text = {}
    for r in media.op10(spark, sf_dir).collect():
        raw = (docs[r.doc_id].text or "").encode()
        data = raw.ljust(max(192, -(-len(raw) // 192) * 192), b" ")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]))
        assert by_text.setdefault(raw, r[1:]) == r[1:]


def test_sniffing_corrects_and_carves(spark):
    png = media.to_png(b"x" * 192)
    gif = b"GIF89a" + bytes([1, 0, 1, 0, 0, 0, 0]) + b"\x2c" + bytes(8) + b"\x00\x02\x02\x44\x01\x00\x3b"
    rows = [(1, "text/plain", png), (2, "image/png", b"junk" + gif + b"more" + png), (3, "image/png", png[:-3]), (4, None, None), (5, None, b"")]
    found = media.corrected(spark.createDataFrame(rows, "doc_id long, type string, media binary"))
    got = {r.doc_id: r for r in found.collect()}
    assert got[1].type == "image/png" and all(got[k].type == media.UNKNOWN for k in (2, 3, 4, 5))
    assert [(e.at, e.length, e.type) for e in got[2].embedded] == [(4, len(gif), "image/gif"), (8 + len(gif), len(png), "image/png")]
    assert {bytes(r.media) for r in media.carved(found).collect()} == {gif, png}


# -- all -----------------------------------------------------------------------------------------
def whole(spark, tmp_path, rows):
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 0)], "doc_id long, quality int, toxic int")
    chats = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    pages = spark.createDataFrame([(1, None, None)], "page_id long, url string, html string")
    return as_sf(tmp_path, documents=rows, labels=labels, conversations=chats, pages=pages)


@pytest.mark.parametrize("kind", ["empty", "odd", "null_ids", "clashing"])
def test_every_query_on_odd_tables(spark, tmp_path, kind):
    rows = table(spark, ODD)
    rows = {"empty": rows.limit(0), "odd": rows, "null_ids": rows.withColumn("doc_id", F.lit(None).cast("long")).withColumn("source", F.lit(None).cast("string")), "clashing": clashing(rows)}[kind]
    sf = whole(spark, tmp_path, rows)
    n = 0 if kind == "empty" else len(ODD)
    for name, query in queries.QUERIES.items():
        made = query(spark, sf).collect()
        if name[:4] in ("op2_", "op3_", "op6_", "op7_", "op8_", "op9_", "op10"):
            assert len(made) == n, name
    corpus_pipeline.run(spark, sf).collect()


def brute_groups(texts):
    """Smallest id of each text's group: all pairs of similarity 0.8 or more are links."""
    grams, root = {k: five_words(t) for k, t in texts.items()}, {k: k for k in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if min(len(grams[a]), len(grams[b])) >= 0.8 * max(len(grams[a]), len(grams[b])):
                both = len(grams[a] & grams[b])
                if both >= 0.8 * (len(grams[a]) + len(grams[b]) - both):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {k: find(k) for k in ids}


def test_pipeline_stage_by_stage(spark, sf_dir, docs):
    """Rules, one document of each group, masks, the mix's words and the packed ids, each against brute force."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    good = corpus_pipeline.quality_rules(spark, rows, sf_dir).cache()
    verdict = {r.doc_id for r in rules.op9(spark, sf_dir).where("kept").collect()}
    assert sorted(r.doc_id for r in good.collect()) == sorted(verdict)
    single = corpus_pipeline.near_dedup(spark, good, sf_dir).cache()
    assert sorted(r.doc_id for r in single.collect()) == sorted(set(brute_groups({k: docs[k].text for k in verdict}).values()))
    safe = corpus_pipeline.mask_secrets(spark, single, sf_dir).cache()
    assert safe.columns == corpus_pipeline.COLUMNS and safe.count() == single.count()
    assert not any(brute_base(r.text) for r in safe.collect() if not re.search(r"(?i)(password|passwd|secret|token|api_?key)", r.text))
    mixed = corpus_pipeline.mix_sources(spark, safe, sf_dir).cache()
    sizes, taken = Counter(), Counter()
    for r in safe.collect():
        sizes[r.source] += len(WORD.findall(r.text))
    for r in mixed.collect():
        taken[r.source] += len(WORD.findall(r.text))
    assert all(abs(taken[s] - t) <= 33 for s, t in brute_targets(dict(sizes)).items())
    packed = corpus_pipeline.pack_sequences(spark, mixed, sf_dir).collect()
    encoder = tokens.Encoder(packing.vocabulary("byte_bpe_50k.json"))
    assert sum(p.length for p in packed) == sum(len(encoder.encode(r.text)) // 4 + 1 for r in mixed.collect())


def five_words(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {hash(" ".join(words[i : i + 5])) for i in range(max(1, len(words) - 4))} if words else set()


def test_pipeline_dedup_stage_drops_near_copies_and_keeps_clean_documents(spark, sf_dir):
    rng = random.Random(8)
    made = []
    for _ in range(60):  # a text, two near copies of it, and one that shares half of it
        words = [f"w{rng.randrange(3000)}" for _ in range(200)]
        near = [w if rng.random() > 0.01 else "changed" for w in words]
        made += [" ".join(words), " ".join(near), "  ".join(near[:-3]).upper(), " ".join(words[:100] + [f"v{rng.randrange(3000)}" for _ in range(100)])]
    stage = dict(corpus_pipeline.STAGES)["near_dedup"]
    for rows in (table(spark, [*made, *ODD]), spark.read.parquet(f"{sf_dir}/documents.parquet")):
        texts = {r.doc_id: r.text for r in rows.collect()}
        assert {r.doc_id for r in stage(spark, rows, sf_dir).collect()} == set(brute_groups(texts).values())


def test_dedup_joins_what_the_first_links_leave_apart(spark, monkeypatch):
    """A chain of near copies, and a hot group around one original, cut into tiles."""
    rng = random.Random(9)
    words = [f"w{rng.randrange(9999)}" for _ in range(300)]
    chain = [" ".join(words[:k] + [f"x{k}a{j}" for j in range(2)] + words[k:]) for k in range(0, 300, 10)]
    chain = [" ".join(words)] + [" ".join(words[3 * k :] + [f"y{i}" for i in range(3 * k)]) for k in range(1, 40)] + chain
    star = [" ".join(w if rng.random() > 0.03 else f"z{rng.randrange(10**6)}" for w in words[::-1]) for _ in range(150)] + [" ".join(words[::-1])]
    rows = table(spark, chain + star)
    monkeypatch.setattr(similar, "TILE", 32)
    monkeypatch.setattr(similar, "TILE_OF_SETS", 16)
    texts = {r.doc_id: r.text for r in rows.collect()}
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, rows, "").collect()} == set(brute_groups(texts).values())


def test_dedup_keeps_one_of_repeated_rows_and_null_ids(spark):
    text = "one two three four five six seven"
    rows = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in [(1, text), (1, text), (None, text), (None, text), (2, text), (None, "other"), (None, "other"), (7, None), (None, "")]], DOC)
    got = corpus_pipeline.near_dedup(spark, clashing(rows), "").collect()
    assert sorted((r.doc_id is None, r.doc_id, r.text) for r in got if r.doc_id) == [(False, 1, text), (False, 7, None)] and [r.text for r in got if r.doc_id is None] == ["other"]


@pytest.mark.parametrize("radius, rows", [(3, 1), (3, 10**9), (3, 10**13), (1, 1), (5, 1)])
def test_links_by_any_tables(spark, radius, rows):
    rng = random.Random(radius)
    base = [rng.getrandbits(64) for _ in range(20)]
    fps = sorted({rng.choice(base) ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(0, radius + 3))) for _ in range(200)})
    signed = spark.createDataFrame([((v ^ (1 << 63)) - (1 << 63),) for v in fps], "fp long")
    root = {r.node & (2**64 - 1): r.root for r in simhash.components(simhash.near_links(signed, radius, 16, rows)).collect()}
    want, made, ids = defaultdict(set), defaultdict(set), dict(enumerate(fps))
    for i, r in brute_components(ids, radius).items():
        want[r].add(ids[i])
    for v in fps:
        made[root.get(v, ("alone", v))].add(v)
    assert {frozenset(g) for g in made.values()} == {frozenset(g) for g in want.values()}
