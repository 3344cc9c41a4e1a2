"""Each operator against brute force, with nulls, empty and long texts, repeats, empty tables and clashing columns."""

import hashlib
import html as html_lib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from quern.llm import chat, html, langid, line_dedup, mixing, ngram_join, packing, quality, secrets, topk
from quern.llm.common import Stages, components

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, _row long, base string, h string"


def documents(rows, texts, lang="en"):
    return rows(DOCS, [(i, t, lang, "s", len(t or ""), 7, "b", "h") for i, t in enumerate(texts)])


PROSE = [" ".join(f"w{(i * 7 + j * j) % 97}" for j in range(60)) for i in range(6)]
ODD = [None, "", " \n\t", "x", PROSE[0], PROSE[0], PROSE[1], PROSE[0] + " tail", "long " * 40_000]


def test_components(spark, rows):
    edges = [(1, 2), (2, 3), (9, 8), (5, 5), (3, 1), (7, 9), (20, 21)] + [(i, i + 1) for i in range(100, 140)]
    got = dict(map(tuple, components(Stages(spark, "t"), rows("a long, b long", edges)).collect()))
    assert got[3] == got[1] == 1 and got[9] == got[8] == got[7] == 7 and got[140] == 100 and got[21] == 20
    assert components(Stages(spark, "t"), rows("a long, b long", [])).count() == 0


def test_staged_tables_need_a_shared_folder():
    from types import SimpleNamespace as Fake

    from quern.llm.common import shared_dir

    session = lambda conf, given, master: Fake(conf=Fake(get=lambda key, other: conf or other), sparkContext=Fake(getCheckpointDir=lambda: given, master=master))
    assert shared_dir(session("hdfs:///a", None, "yarn")) == "hdfs:///a" and shared_dir(session(None, "hdfs:///b", "yarn")) == "hdfs:///b"
    assert shared_dir(session(None, None, "local[8]")).endswith("checkpoints") and shared_dir(session(None, None, "local")).endswith("checkpoints")
    for master in ("yarn", "spark://host:7077", "local-cluster[3,2,1000]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_dir(session(None, None, master))


def test_topk_matches_brute_force(spark, rows):
    rng = np.random.default_rng(0)
    data = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(300)]
    data += [(300, None), (301, [float("nan")] * 8), (302, [None] * 8), (None, [0.1] * 8), (303, [1e300] * 8), (304, []), *data[:5]]
    df = rows("vec_id long, embedding array<double>", data)
    v = df.select(F.col("vec_id").alias("id"), topk.integer_vector(F.col("embedding")).alias("v"))
    got = topk.exact_topk(v.where("id % 20 = 0"), v, 5).collect()
    ok = [(i, [math.floor(64 * x) for x in e]) for i, e in data if i is not None and e and all(x is not None and math.isfinite(x) for x in e)]
    limit = 2**63
    # floor() of a double beyond 64 bits is the nearest long
    ok = [(i, [max(-limit, min(limit - 1, x)) for x in e]) for i, e in ok]
    want = []
    for q, a in {(i, tuple(e)) for i, e in ok if i % 20 == 0}:
        scored = sorted(((-sum(x * y for x, y in zip(a, b)), c) for c, b in ok if c != q))[:5]
        want += [(q, r, c, max(-limit, min(limit - 1, -s))) for r, (s, c) in enumerate(scored, 1)]
    assert sorted(map(tuple, got)) == sorted(want)
    assert topk.exact_topk(v.limit(0), v, 5).count() == 0 and topk.exact_topk(v.where("id = 0"), v.limit(0), 5).count() == 0


def test_html_cases():
    def text(h):
        return html.main_text(html.Page(h), [], frozenset())

    page = (
        "<!DOCTYPE html><title>no</title><script>if (a<b) '</p>'</script><nav><a href=/>Home</a></nav><div class='cookie-notice'>We use</div>"
        "<header><h1>Site</h1></header><main><article><header><h1>T &amp; t</h1></header><p>One<br>two &lt;b&gt; <b>bold <p>three<div class=ad>buy</div>"
        "<ul><li>a<li>b&nbsp;c</ul><form>mail</form><aside>rel</aside><section id=comments><p>nice</section></article></main><footer>end</footer>"
    )
    assert text(page) == "T & t\nOne two <b> bold\nthree\na\nb c"
    assert text("") == "" and text("plain  text") == "plain text" and text("<p>a<!-- x > y --><p>b") == "a\nb"
    assert text("<div hidden>x</div><div style='display: none'>y</div><p title='a>b'>z</p>") == "z"
    assert text("<p>" * 5000 + "deep") == "deep"


def test_wrapper_finds_constant_slots(rows):
    page = lambda i: f"<html><body><div class=top>Welcome to the site</div><div class=c><p>Story {i} of {i * i}</p><p>More {i}</p><p>Read our terms</p></div><div class=x><a href=/{i}>link {i}</a></div></body></html>"
    data = [(i, f"https://h.example/{i}", page(i)) for i in range(30)] + [(90, None, None), (91, "https://h.example/91", ""), (92, "nope", "<p>alone</p>"), (1, "https://h.example/1", page(1))]
    got = sorted(map(tuple, html.extract_text(rows("page_id long, url string, html string", data)).collect()), key=str)
    texts = {i: t for i, _, t in got}
    assert len(got) == len(data)
    assert texts[3] == "Story 3 of 9\nMore 3" and texts[90] == "" and texts[91] == "" and texts[92] == "alone"
    assert html.extract_text(rows("page_id long, url string, html string", [])).count() == 0


def test_simple_tree_matching():
    flat = lambda *x: tuple(x)
    a = flat(("r", -1), ("x", 0), ("y", 0), ("z", 2), ("w", 0))
    b = flat(("r", -1), ("y", 0), ("z", 1), ("x", 0), ("w", 0))
    n, pairs = html.match(a, b)
    assert n == 4 and pairs == {0: 0, 2: 1, 3: 2, 4: 4}


def plain_matching(a, b):
    kids = lambda t, i: [k for k, (_, p) in enumerate(t) if p == i]

    def solve(x, y):
        if a[x][0] != b[y][0]:
            return 0
        p, q = kids(a, x), kids(b, y)
        best = [[0] * (len(q) + 1) for _ in range(len(p) + 1)]
        for i in range(len(p)):
            for j in range(len(q)):
                best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + solve(p[i], q[j]))
        return 1 + best[-1][-1]

    return solve(0, 0)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 30)), max_size=12), st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 30)), max_size=12))
def test_tree_matching_against_the_plain_recursion(x, y):
    def ordered(nodes):
        root = html.Node("r", False, False)
        made = [root]
        for sign, parent in nodes:
            made.append(html.Node(sign, False, False))
            made[parent % (len(made) - 1)].children.append(made[-1])
        listed, parents = html.preorder(root)
        return tuple((n.sign, p) for n, p in zip(listed, parents))

    a, b = ordered(x), ordered(y)
    n, pairs = html.match(a, b)
    assert n == plain_matching(a, b) == len(pairs) == len(set(pairs.values()))
    assert all(a[i][0] == b[j][0] and (i == 0 or pairs[a[i][1]] == b[j][1]) for i, j in pairs.items())


def test_html_deep_and_unclosed_input(rows):
    import time

    odd = {
        1: "<div>" * 5000 + "deep" + "</div>" * 5000, 2: "x" + "<a " * 100_000, 3: "x" + '<a ">"' * 50_000, 4: "<b>" * 50_000 + "<hr>" * 50_000 + "t",
        5: "<div>" * 20_000 + "</section>" * 20_000 + "t", 6: "<p>a <!-- never closed <p>b", 7: "a < b > c <3 d", 8: "<script>" * 1000 + "no", 9: "y" + "<a '" * 50_000,
        10: "<p class='x>y</p>z", 11: "<p>one<h2>two</h2>" * 3000,
    }
    start = time.perf_counter()
    data = [(k, "https://odd.example/", v) for k, v in odd.items()] + [(20, "https://odd.example/", odd[1])]
    got = {i: t for i, _, t in map(tuple, html.extract_text(rows("page_id long, url string, html string", data)).collect())}
    assert got[1] == got[20] == "deep" and got[4] == got[5] == "t" and got[6] == "a" and got[7] == "a < b > c <3 d" and got[8] == ""
    assert got[2].startswith("x") and got[11].split("\n")[:2] == ["one", "two"] and len(got) == 12
    assert time.perf_counter() - start < 60


def test_wrapper_alone_finds_the_template(rows):
    # no element, class or id tells what is what: only alignment can
    page = lambda i: (
        f"<html><body><div><div><span>Acme Weekly</span></div><div><b>Story {i}</b></div><div>Text of {i} and {i * 7}</div>"
        f"{'<div>Extra ' + str(i) + '</div>' if i % 3 == 0 else ''}<table><tr><td>All rights kept</td></tr></table></div></body></html>"
    )
    data = [(i, f"https://plain.example/{i}", page(i)) for i in range(12)] + [(100 + i, f"https://two.example/{i}", page(i)) for i in range(2)]
    table = rows("page_id long, url string, html string", data)
    got = {i: t for i, _, t in map(tuple, html.extract_text(table).collect())}
    assert all(got[i].split("\n")[-1] != "All rights kept" and "Acme Weekly" not in got[i] and f"Text of {i} and" in got[i] for i in range(12)), got
    # without the model, or with too few pages to learn one, it stays
    assert html.main_text(html.Page(page(1)), [], frozenset()).endswith("All rights kept") and got[100].endswith("All rights kept")


CONTENT_NAMES = ["search-results", "social-science", "related-work", "notice-period", "market-share", "ad-hoc-report", "railMap", "alert_levels", "banner-history"]
PART_NAMES = ["search", "ad", "ad-slot", "share-bar", "social-links", "top-menu", "widget 3", "loginForm", "cookie-notice-text", "reader-comments", "NewsletterBox", "sidebar-left"]


@pytest.mark.parametrize("name", CONTENT_NAMES)
def test_html_words_in_other_compounds_are_content(name):
    at = lambda attribute, inner: f"<body><div><p>first text</p></div><div {attribute}='{name}'>{inner}</div><p>last text</p></body>"
    for attribute in ("class", "id"):
        page = html.Page(at(attribute, "<p>what it says, see <a href=x>here</a> and on</p>"))
        assert html.main_text(page, [], frozenset()) == "first text\nwhat it says, see here and on\nlast text"
    menu = html.Page(at("class", "<ul><li><a href=x>one of the links</a></li><li><a href=y>another of them</a></li></ul>"))
    assert html.main_text(menu, [], frozenset()) == "first text\nlast text"  # its links tell


@pytest.mark.parametrize("name", PART_NAMES)
def test_html_names_of_parts(name):
    page = html.Page(f"<body><p>first text</p><div class='{name}'><p>not a part of it</p></div><p>last text</p></body>")
    assert html.main_text(page, [], frozenset()) == "first text\nlast text"


def test_html_states_are_no_parts():
    text = lambda h: html.main_text(html.Page(h), [], frozenset())
    assert text("<article class='post comments-open'><p>kept</p><div class='comments'>no</div></article>") == "kept"
    assert text("<div class='content with-sidebar'><article>kept</article><div class='sidebar'>no</div></div>") == "kept"
    assert text("<main><p>kept</p><article class='comment'>no</article></main>") == "kept"


def brute_components(texts):
    sets = {}
    for i, t in texts:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if 100 * common >= 75 * len(sets[a] | sets[b]):
                    x, y = sorted((find(a), find(b)))
                    parent[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_ngram_join_matches_brute_force(rows):
    import random

    rng = random.Random(1)
    texts = list(ODD)
    for base in PROSE[:3]:
        for _ in range(25):
            w = base.split()
            for _ in range(rng.choice([1, 1, 2, 3])):
                w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
            texts.append(" ".join(w))
    texts += ["A b C", "a B c", "A b\x0bC", "a b c d e", "A B C D E", "a b c d e f"]
    got = ngram_join.jaccard_components(documents(rows, texts)).collect()
    want = brute_components(list(enumerate(texts)))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want and len(got) == len(texts)
    kept = ngram_join.keep_one(documents(rows, texts))
    assert kept.count() == len({c for _, c in want.values()}) and kept.columns == [c.split()[0] for c in DOCS.split(", ")]
    assert ngram_join.jaccard_components(documents(rows, [])).count() == 0
    same = ngram_join.jaccard_components(rows("doc_id long, text string", [(None, "a b"), (None, "a b"), (1, "a b")])).collect()
    assert [r["component_id"] for r in same] == [1, 1, 1]


def test_ngram_join_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute_components([(r["doc_id"], r["text"]) for r in docs.collect()])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(docs).collect()}
    assert got == want


def test_packed_arrays_round_trip():
    arrays = [np.arange(5, dtype=np.uint64) * 10**15, np.zeros(0, np.uint8), np.array([3, 70_000], np.uint32)]
    assert [a.tolist() for a in ngram_join.unpack(ngram_join.pack(*arrays))] == [a.tolist() for a in arrays]


TEXT = st.text(st.one_of(st.sampled_from("<|\\>turnextd/ \n"), st.characters(codec="utf-8", exclude_categories=["Cs"])), max_size=30)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "<|end|>", ""]), TEXT), max_size=5))
def test_chat_round_trip_and_mask(turns):
    if not hasattr(test_chat_round_trip_and_mask, "encoder"):
        import public_tokenizers

        test_chat_round_trip_and_mask.encoder = chat.tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    formatted, spans = chat.render(turns)
    assert chat.parse(formatted) == turns
    e = test_chat_round_trip_and_mask.encoder.encode(formatted, add_special_tokens=False)
    loss = chat.mask(e.offsets, spans)
    under = chat.masked_text(formatted, [a for a, _ in e.offsets], [b for _, b in e.offsets], loss)
    assert "".join(map(chat.unescape, under)) == "".join(t for r, t in turns if r == "assistant")


def test_chat_table(rows):
    data = [(1, 1, "assistant", "b"), (1, 0, "user", None), (None, 0, None, "x"), (2, 0, "assistant", "é<|end|>\\"), (2, 0, "assistant", "é<|end|>\\")]
    got = {r["conv_id"]: r for r in chat.digest(chat.format_conversations(rows("conv_id long, turn long, role string, text string", data))).collect()}
    assert got[1]["turns_sha256"] == hashlib.sha256(b"user\n\nassistant\nb\n").hexdigest() and got[1]["loss_chars"] == 1
    assert got[2]["n_turns"] == 2 and got[2]["loss_sha256"] == hashlib.sha256("é<|end|>\\é<|end|>\\".encode()).hexdigest()
    assert got[None]["loss_chars"] == 0


@settings(max_examples=200, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" \n\t  a1'.,s\x1c"), st.characters(codec="utf-8", exclude_categories=["Cs"])), max_size=60))
def test_word_encoder_equals_the_whole_text(text):
    if not hasattr(packing, "_test"):
        import public_tokenizers
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
        whole.encode_special_tokens = True
        packing._test = (packing.WordEncoder(public_tokenizers.path("byte_bpe_50k.tiktoken")), whole)
    encode, whole = packing._test
    assert np.frombuffer(encode(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


def test_word_encoder_gives_added_tokens_their_ids():
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode = packing.WordEncoder(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    for text in ("<|endoftext|>", "a b <|endoftext|> c", "x<|endoftext|><|endoftext|>\ny  z", " <|endoftext|>", "<|endoftext", "plain words"):
        assert np.frombuffer(encode(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, text


def check_packed(pieces, sizes, window):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in pieces:
        by_doc[r[0]].append((r[1], r[2], r[3]))
        by_seq[r[4]].append((r[5], r[2]))
    for doc, size in sizes.items():
        at = 0
        for start, length, total in sorted(by_doc[doc]):
            assert start == at and length > 0 and total == size
            at += length
        assert at == size
    padding = 0
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
        padding += 0 if at.bit_count() == 1 else window - at
    return padding


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 5000), max_size=80))
def test_packing_keeps_every_id(sizes):
    documents_ = [(i, np.arange(n, dtype="<u4").tobytes()) for i, n in enumerate(sizes)]
    rows_ = list(packing.pack_rows(iter(documents_), 1024, 0))
    assert check_packed(rows_, dict(enumerate(sizes)), 1024) == 0
    for doc, start, length, _, _, _, ids in rows_:
        assert np.frombuffer(ids, "<u4").tolist() == list(range(start, start + length))


def test_sum_of_squares_choice():
    p = packing.SumOfSquares(10, 0)
    for size in (6, 6, 6):
        p.place((0, 0, size))
    assert p.levels[6] == 3
    assert p.place((0, 0, 4))[0][0] == 2 and p.levels[6] == 2  # filling a crowded level lowers the squares most
    p.place((0, 0, 1))
    assert p.levels[6] == 1 and p.levels[7] == 1  # leaving the crowded level beats a new window


def test_packing_table(rows):
    got = packing.pack_documents(documents(rows, ODD)).collect()
    sizes = Counter()
    for r in got:
        sizes[r["doc_id"]] += r["length"]
        assert len(r["token_ids"]) == 4 * r["length"]
    assert sizes[0] == sizes[1] == 1 and sizes[4] == sizes[5]
    assert check_packed([tuple(r) for r in got], dict(sizes), 1024) == 0
    assert packing.pack_documents(documents(rows, [])).count() == 0
    crc = packing.pack_documents(documents(rows, [None])).select(F.crc32("token_ids").alias("c")).first()["c"]
    assert crc == zlib.crc32(b"\0\0\0\0")


def test_line_dedup(rows):
    base = "the quick brown fox jumps over the lazy dog near the river bank today"
    near = base.replace("lazy", "lazi")
    other = "completely different words appear in this particular line of text here"
    texts = [f"{base}\nunique one\n\n", f"{near}\n  \n{other}", f"{other.upper()}\n{base}  ", None, "", "short\nshort", "short", "x" * 60_000]
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(documents(rows, texts)).collect()}
    assert got[0]["text"] == texts[0] and got[1]["text"] == f"  \n{other}" and got[2]["text"] == "" and got[2]["dropped"] == [0, 1]
    assert got[3]["text"] is None and got[4]["text"] == "" and got[5]["text"] == "short" and got[6]["dropped"] == [0] and got[7]["dropped"] == []
    assert got[0]["base"] == "b" and line_dedup.dedup_lines(documents(rows, [])).count() == 0


def shingle_set(line):
    return {line[i : i + 5] for i in range(max(len(line) - 4, 1))}


def edited(rng, line, edits):
    b = list(line)
    for _ in range(edits):
        b[rng.randrange(len(b))] = rng.choice("zy")
    return "".join(b).strip()


def line_kinds(rng, kinds, each):
    """kind -> near pairs of lines: of 3 to 12 words, long ones, ones without spaces, Chinese ones, ones around the length from which shingles are sifted."""
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 9)))
    out = defaultdict(list)
    for kind in kinds:
        while len(out[kind]) < each:
            if kind == "han":
                a = "".join(chr(0x4E00 + rng.randrange(2000)) for _ in range(50))
            elif kind == "joined":
                a = "".join(word() for _ in range(10))
            elif kind == "border":
                a = " ".join(word() for _ in range(30))[: rng.randrange(120, 145)].strip()
            else:
                a = " ".join(word() for _ in range(kind))
            b = edited(rng, a, rng.randint(1, max(1, len(a) // 40)))
            x, y = shingle_set(a), shingle_set(b)
            if 0.75 <= len(x & y) / len(x | y) < 1:
                out[kind].append((a, b))
    return out


def test_line_dedup_against_brute_force(rows):
    import random

    rng = random.Random(9)
    kinds = line_kinds(rng, [*range(3, 13), 40, 120, "border", "joined", "han"], 40)
    lines = [x for pairs in kinds.values() for p in pairs for x in p]
    # groups of copies of copies: neighbours link, far ones need not
    for _ in range(5):
        a = lines[rng.randrange(400, 500)]
        for _ in range(20):
            a = edited(rng, a, 1)
            lines.append(a)
    rng.shuffle(lines)
    sets, holders = [shingle_set(x) for x in lines], defaultdict(list)
    parent = list(range(len(lines)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, x in enumerate(sets):
        for j in {j for g in x for j in holders[g]}:
            if 4 * len(x & sets[j]) >= 3 * len(x | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
        for g in x:
            holders[g].append(i)
    want = {i for i in range(len(lines)) if find(i) != i}
    texts = ["\n".join(lines[i : i + 10]) for i in range(0, len(lines), 10)]
    got = {10 * r["doc_id"] + k for r in line_dedup.dedup_lines(documents(rows, texts)).collect() for k in r["dropped"]}
    assert got <= want and len(got) >= 0.96 * len(want)
    at = {x: i for i, x in enumerate(lines)}
    for kind, pairs in kinds.items():
        assert sum(max(at[a], at[b]) in got for a, b in pairs) >= 36, kind


def pairs_over_one_line(rng, edits, pairs):
    """Pairs of lines at similarity 0.75 to 0.8, all written over one line of 200 characters: few edits, all lines are much alike."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    common = "s" + "".join(rng.choice(letters + " ") for _ in range(198)) + "e"

    def change(line, n):
        line = list(line)
        for _ in range(n):
            line[rng.randrange(1, len(line) - 1)] = rng.choice(letters)
        return "".join(line)

    out = []
    while len(out) < pairs:
        a = change(common, edits)
        b = change(a, rng.randrange(4, 9))
        x, y = shingle_set(a), shingle_set(b)
        if 0.75 <= len(x & y) / len(x | y) < 0.8:
            out += [(a, b)]
    return out


def test_line_dedup_of_pairs_among_lines_much_alike(rows):
    import random

    rng = random.Random(5)
    mixtures = [[x for p in pairs_over_one_line(rng, edits, 70) for x in p] for edits in (14, 7, 5)]
    lines = [(100_000 * k + i, x) for k, mixture in enumerate(mixtures) for i, x in enumerate(mixture)]
    got = line_dedup.dedup_lines(rows("doc_id long, text string", lines)).where(F.size("dropped") > 0)
    dropped = Counter(r["doc_id"] // 100_000 for r in got.collect())
    for k, mixture in enumerate(mixtures):
        sets, name = [shingle_set(x) for x in mixture], list(range(len(mixture)))
        for i in range(len(sets)):
            for j in range(i):
                if len(sets[i] & sets[j]) >= 0.75 * len(sets[i] | sets[j]) and name[i] != name[j]:
                    name = [name[j] if x == name[i] else x for x in name]
        want = len(mixture) - len(set(name))
        assert want >= 70 and 0.95 * want <= dropped[k] <= want


def test_line_dedup_of_lines_with_one_passage(rows, monkeypatch):
    """Lines that hold one passage are much alike and do not link: their pairs must not all be verified."""
    import random

    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage = text(60)
    lines = [f"{text(13)} {passage}" for _ in range(160)]
    lines += [edited(rng, x, 2) for x in lines[:20]]
    sets = [shingle_set(x) for x in lines]
    like = [len(x & y) / len(x | y) for i, x in enumerate(sets) for y in sets[:i]]
    links = sum(s >= 0.75 for s in like)
    assert links == 20 and sorted(like)[len(like) // 2] > 0.6
    seen, similar = [], line_dedup.similar
    monkeypatch.setattr(line_dedup, "similar", lambda pairs: seen.append(pairs.count()) or similar(pairs))
    got = line_dedup.dedup_lines(rows("doc_id long, text string", list(enumerate(lines)))).where(F.size("dropped") > 0)
    assert sorted(r["doc_id"] for r in got.collect()) == list(range(160, 180)) and sum(seen) < 1000


def test_line_parities_let_all_links_through(rows):
    import random

    rng = random.Random(4)
    lines = ["x", "xy", "ab" * 300]
    for n in (6, 30, 200, 700, 4000):
        for edits in (1, 1 + n // 150, 1 + n // 90, 1 + n // 60, n // 6):
            a = "".join(rng.choice("abcdefgh ") for _ in range(n))
            lines += [a, edited(rng, a, edits)]
    known = line_dedup.parities(rows("id long, norm string", list(enumerate(lines)))).localCheckpoint()
    let = {tuple(r) for r in known.alias("x").join(known.alias("y"), F.col("x.id") < F.col("y.id")).where(line_dedup.may_link("x", "y")).select("x.id", "y.id").collect()}
    sets = [shingle_set(x) for x in lines]
    linked = {(i, j) for j in range(len(sets)) for i in range(j) if 4 * len(sets[i] & sets[j]) >= 3 * len(sets[i] | sets[j])}
    assert {r["id"]: r["n"] for r in known.collect()} == {i: len(x) for i, x in enumerate(sets)}
    assert len(linked) > 10 and linked <= let
    assert sum(len(sets[j]) < 1000 for _, j in let) < 2 * len(linked)


def test_line_signatures_depend_on_the_set_of_shingles(rows):
    got = line_dedup.signatures(rows("id long, norm string", [(1, "ab" * 63), (2, "ab" * 200), (2, "ab" * 200), (3, "x")])).orderBy("id").collect()
    assert [r["again"] for r in got] == [False, True, False] and got[0][2:] == got[1][2:] != got[2][2:]


def test_line_dedup_keeps_clashing_columns(rows):
    names = "_row long, _doc string, _ids int, id int, band int, text string, dropped string, doc_id long, component int, a int"
    data = [(7, "d", 1, 2, 3, "one line here\nother", "mine", None, 4, 5), (7, "e", 1, 2, 3, "One line here \nnew", "mine", 1, 4, 5), (8, None, None, None, None, None, None, 1, None, None)]
    got = line_dedup.dedup_lines(rows(names, data))
    assert sorted(got.columns) == sorted(["_row", "_doc", "_ids", "id", "band", "doc_id", "component", "a", "text", "n_lines", "dropped"])
    assert sorted((r["_row"], r["_doc"], r["a"], r["text"], r["n_lines"], r["dropped"]) for r in got.collect() if r["_doc"]) == [
        (7, "d", 5, "one line here\nother", 2, []), (7, "e", 5, "new", 2, [0]),
    ]


ASSIGN = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_spans(text):
    found = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(k, a, b) for a, _, b, k in sorted(found)]


def test_secret_spans(spark, rows):
    key = "Zk3_x9Qw-71mNopRtUvB2"
    texts = [
        None, "", "😀 token = \"abc\" Password: 'hunter22' secret=token:abcdefgh", "AKIA" + "A1B2" * 5 + " AKIASHORT", "0" * 23 + "g" + "ab12" * 7,
        f"use {key} here", f"use {'Example' + key} there", "api_key=" + "deadbeef" * 4, "TOKEN:" + "x" * 50_000,
    ]
    df = documents(rows, texts).unionByName(rows(DOCS, [(50, f"a {'Example' + key}", "en", "other", 0, 7, "b", "h"), (51, None, None, None, 0, 7, "b", "h")]))
    got = {r["doc_id"]: r for r in secrets.scan_secrets(df).collect()}
    for i, t in enumerate(texts):
        assert [(s["kind"], s["start"], s["end"]) for s in got[i]["base"]] == base_spans(t or ""), i
    assert [(s["start"], s["end"]) for s in got[5]["owned"]] == [(4, 4 + len(key))] and got[6]["owned"] == [] == got[50]["owned"]
    assert secrets.scan_secrets(documents(rows, [])).count() == 0


def test_secrets_on_documents(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in secrets.op7_secret_scan(spark, SF).collect():
        want = ",".join(f"{k}:{a}:{b}" for k, a, b in base_spans(docs[r["doc_id"]]))
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()


def test_language_accuracy_on_held_out_documents(spark):
    sf = SF.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    r = langid.op8_language_id(spark, sf).join(docs, "doc_id").where("held_out").select((F.col("lang") == F.col("lang_pred")).alias("ok"), "score").collect()
    assert len(r) > 100 and sum(x["ok"] for x in r) / len(r) > 0.97 and all(0 <= x["score"] <= 1 for x in r)


def test_language_cases(spark, rows):
    en = ["the cat and the dog went to the house with that thing " * 3] * 8
    de = ["der hund und die katze gingen zu dem haus mit dem ding " * 3] * 8
    table = documents(rows, en).unionByName(documents(rows, de, "de")).unionByName(documents(rows, ["x"], None))
    model = langid.learn(table)
    assert model[0] == ["de", "en"]
    mixed = (en[0] + de[0]) * 3
    ask = documents(rows, [en[0], de[0], None, "", "123 %%", mixed, en[0] * 500])
    got = {r["doc_id"]: r for r in langid.identify(ask, model).collect()}
    assert [got[i]["lang_pred"] for i in (0, 1, 2, 3, 4)] == ["en", "de", "und", "und", "und"]
    assert sorted(got[5]["langs"]) == ["de", "en"] and 0.3 < got[5]["shares"][1] <= 0.5 and got[6]["langs"] == ["en"]
    assert langid.identify(documents(rows, []), model).count() == 0
    assert langid.identify(ask, langid.learn(documents(rows, []))).where("lang_pred <> 'und'").count() == 0
    alone = langid.predict([en[0]], *model)[0]
    assert langid.predict([de[0], en[0]], *model)[1] == alone  # neighbours in a chunk do not matter


def test_mixing_meets_targets(spark, rows):
    data = [(i, f"good plain word{i % 9} text {'fine ' * 20}" if i % 3 else f"bad idiot moron word{i % 9} {'fine ' * 20}") for i in range(300)]
    docs = rows("doc_id long, text string", [*data, (900, None), (901, "")])
    labelled = rows("doc_id long, domain string", [(i, "clean" if i % 3 else "rude") for i in range(150)] + [(5000, "clean")])
    mixed = mixing.mix_rates(docs, labelled, {"clean": 0.9, "rude": 0.1}, "clean").collect()
    assert len(mixed) == 302 and all(r["rate"] >= 0 for r in mixed)
    total = [sum(r["rate"] * r["tokens"] * r["posteriors"][k] for r in mixed) for k in (0, 1)]
    start = sum(r["tokens"] * r["posteriors"][0] for r in mixed)
    assert abs(total[0] - start) < 0.02 * start and abs(total[1] / total[0] - 1 / 9) < 0.02
    gone = mixing.resample(docs, labelled, {"clean": 1.0, "rude": 0.0}, "clean").collect()
    assert {r["doc_id"] for r in gone} >= {i for i, _ in data if i % 3} and not [r for r in gone if r["doc_id"] < 300 and r["doc_id"] % 3 == 0]
    assert mixing.mix_rates(docs.limit(0), labelled, mixing.WEIGHTS, "high").count() == 0
    assert mixing.mix_rates(docs, labelled.limit(0), mixing.WEIGHTS, "high").count() == 302


@pytest.mark.parametrize("one_in", [300, 1000])
def test_mixing_meets_targets_of_rare_domains(rows, one_in):
    data = [([0.001, 0.998, 0.001] if i % one_in == 1 else [0.02, 0.01, 0.97] if i % 30 == 0 else [0.997, 0.002, 0.001], 50.0 + i % 7) for i in range(3000)]
    table = rows("_p array<double>, _t double", data)
    lift, miss = mixing.fit_rates(table, [0.85, 0.15, 0.0], 0)
    got = [r[0] for r in table.select(mixing.rate_of(F.col("_p"), lift)).collect()]
    total = [sum(r * t * p[k] for r, (p, t) in zip(got, data)) for k in range(3)]
    start = sum(t * p[0] for p, t in data)
    assert min(got) >= 0 and abs(total[0] / start - 1) < 0.002 and abs(total[1] / (start * 15 / 85) - 1) < 0.002, (total, miss)


@pytest.mark.parametrize("rate", [0.92, 1.08])
def test_dealt_copies_meet_the_fitted_totals(rows, rate):
    mixed = rows("draw long, posteriors array<double>, tokens long, rate double", [(i, [0.9, 0.1], 100, rate) for i in range(4000)])
    mixed = mixed.withColumn("copies", mixing.copies(F.col("rate"), F.col("draw")))
    got = {r["domain"]: r for r in mixing.domain_totals(mixed, {"a": 0.9, "b": 0.1}, "a").collect()}
    assert abs(got["a"]["dealt"] / got["a"]["fitted"] - 1) < 0.02 and abs(got["b"]["target"] - 40_000) < 1
    assert abs(got["a"]["fitted"] - 360_000 * rate) < 1


def plain_posteriors(texts, labels, domains):
    """A plain form of the classifier: presence of token buckets, counted and scored one document at a time."""

    def buckets(t):
        return {zlib.crc32(x.encode()) for x in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+|[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]+", (t or "").lower())}

    seen = [(buckets(texts[i]), d) for i, d in labels.items() if i in texts]
    sizes = {d: 1 + sum(x == d for _, x in seen) for d in domains}
    total, evidence, base = sum(sizes.values()), {}, {d: math.log(sizes[d] / sum(sizes.values())) for d in domains}
    for b in {b for s, _ in seen for b in s}:
        n = {d: sum(b in s for s, x in seen if x == d) for d in domains}
        share = sum(n.values()) / total
        if sum(n.values()) < mixing.SUPPORT or sum((n[d] - sizes[d] * share) ** 2 / (sizes[d] * share + 1) for d in domains) < mixing.SIGNIFICANT:
            continue
        if max((n[d] + 1) / (sizes[d] + 2) * (total - sizes[d] + 2) / (sum(n.values()) - n[d] + 1) for d in domains) < mixing.LIFT:
            continue
        for d in domains:
            q = (n[d] + 1) / (sizes[d] + 2)
            base[d] += math.log(1 - q)
            evidence[b, d] = math.log(q / (1 - q))
    out = {}
    for i, t in texts.items():
        logit = [base[d] + sum(evidence.get((b, d), 0) for b in buckets(t)) for d in domains]
        e = [math.exp(x - max(logit)) for x in logit]
        out[i] = [x / sum(e) for x in e]
    return out


def test_mixing_against_plain_classifier_and_least_squares(rows):
    import random

    rng = random.Random(4)
    texts, labels = {}, {}
    for i in range(900):
        d = ("high", "low", "toxic")[0 if i % 10 < 7 else 1 if i % 10 < 9 else 2]
        words = [f"w{rng.randrange(60)}" for _ in range(rng.randrange(5, 60))]
        words += rng.sample({"high": ["theorem", "proof", "lemma"], "low": ["click!!", "buy", "$$$"], "toxic": ["idiot", "scum", "moron"]}[d], rng.randrange(0, 3))
        rng.shuffle(words)
        texts[i], labels[i] = " ".join(words), d
    weights = {"high": 0.8, "low": 0.2, "toxic": 0.0}
    docs = rows("doc_id long, text string", [*texts.items(), (None, "theorem w1"), (None, "theorem w1"), (1000, None)])
    labelled = rows("doc_id long, domain string", [(i, d) for i, d in labels.items() if i % 2])
    mixed = mixing.mix_rates(docs, labelled, weights, "high").collect()
    want = plain_posteriors(texts, {i: d for i, d in labels.items() if i % 2}, list(weights))
    got = {r["doc_id"]: r for r in mixed}
    assert len(mixed) == 903 and max(abs(a - b) for i, p in want.items() for a, b in zip(p, got[i]["posteriors"])) < 0.01
    # plain projected gradient on the rates of the classes of equal documents, to convergence, from the same posteriors
    p, t = np.array([r["posteriors"] for r in mixed]), np.array([r["tokens"] for r in mixed], float)
    start = t @ p
    target = start[0] / 0.8 * np.array([0.8, 0.2, 0.0])
    scale, rate = np.maximum(start, target), np.ones(len(t))
    a = (p * t[:, None] / scale).T
    step = 1 / np.linalg.norm(a @ np.diag(1 / t.clip(1)) @ a.T, 2)
    for _ in range(30_000):
        rate = np.maximum(0, rate - step * (a.T @ (a @ rate - target / scale)) / t.clip(1))
    here = np.array([r["rate"] for r in mixed])
    # on the misses it must be as good as the plain solution
    assert np.abs(a @ here - target / scale).max() < np.abs(a @ rate - target / scale).max() + 2e-3


def test_mixing_odd_input(rows):
    names = "doc_id long, text string, _row long, _doc string, rate string, tokens string, copies string, b int, e0 int, _all string, posteriors int"
    long = "plain words " * 50_000
    data = [(1, long, 5, "d", "mine", "x", "y", 1, 2, "a", 3), (1, long, 5, "d", "mine", "x", "y", 1, 2, "a", 3), (None, None, None, None, None, None, None, None, None, None, None)]
    labelled = rows("doc_id long, domain string", [(1, "high"), (None, "low"), (9, "toxic")])
    weights = {"high": 1.0, "low": 0.0}
    got = mixing.mix_rates(rows(names, data), labelled, weights, "high").collect()
    assert sorted(((r["doc_id"] or 0, r["tokens"], r["_doc"] or "", r["e0"] or 0) for r in got)) == [(0, 0, "", 0), (1, 100_000, "d", 2), (1, 100_000, "d", 2)]
    assert {r["tokens"] for r in got} == {0, 100_000} and {r["_row"] for r in got} == {5, None}
    back = mixing.resample(rows(names, data), labelled, {"high": 1.0}, "high")
    assert back.columns == rows(names, data).columns and sorted(map(str, back.collect())) == sorted(map(str, rows(names, data).collect()))


def test_mixing_reports_targets_that_cannot_be_met(spark, rows):
    docs = rows("doc_id long, text string", [(i, f"plain words {i}") for i in range(20)])
    with pytest.warns(UserWarning, match="misses its token targets"):
        mixing.mix_rates(docs, rows("doc_id long, domain string", []), mixing.WEIGHTS, "high").count()


def test_owners_decide_and_copies_are_one_repository(rows):
    own, shared = "aB3dE5fG7hJ9kL2mN4pQ", "zZ9yY8xX7wW6vV5uU4tT"
    data = [(i, f"see {own} here", "a") for i in range(4)] + [(10 + i, f"other {own} text {i}", "a") for i in range(5)]
    data += [(20, f"see {shared} here", "a"), (21, f"see {shared} here", "b"), (22, f"null {own[::-1]}", None), (23, None, "b")]
    table = rows("doc_id long, text string, source string", data)
    found = {r["doc_id"]: [s["value"] for s in r["owned"]] for r in secrets.scan_secrets(table).collect()}
    assert all(found[i] == [own] for i in [*range(4), *range(10, 15)])
    assert found[20] == found[21] == found[23] == [] and found[22] == [own[::-1]]
    few = {r["doc_id"]: len(r["owned"]) for r in secrets.scan_secrets(table, max_repositories=5).collect()}
    assert few[0] == 0 and few[22] == 1  # six different texts; the four copies are one of them
    assert {r["doc_id"]: len(r["owned"]) for r in secrets.scan_secrets(table, max_repositories=6).collect()}[0] == 1


def test_secret_scan_of_many_matches_and_clashing_columns(rows):
    many = " ".join(f"token={i:06d}x Zk{i}x9Qw-71mNopRtUvB{i % 7}" for i in range(20_000))
    names = "doc_id long, text string, source string, base string, owned string, live string, _row int, _h int, _owner string"
    table = rows(names, [(1, many, "a", "x", "y", "z", 1, 2, "o"), (1, many, "a", "x", "y", "z", 1, 2, "o"), (None, None, None, None, None, None, None, None, None)])
    got = secrets.scan_secrets(table).collect()
    assert sorted(got[0].asDict()) == sorted(["doc_id", "source", "base", "owned", "live", "_row", "_h", "_owner"])
    for r in got:
        text = many if r["doc_id"] else ""
        assert [(s["kind"], s["start"], s["end"]) for s in r["base"]] == base_spans(text)
        assert [(s["start"], s["end"]) for s in r["owned"]] == [m.span() for m in re.finditer(r"Zk[A-Za-z0-9_-]{18,}", text) if len(set(m[0])) >= 10]


def test_keep_one_keeps_clashing_columns(rows):
    names = "doc_id long, text string, _row long, key string, row int, set_id string, words string, component_id int"
    a, b = PROSE[0], PROSE[1]
    data = [(1, a, 5, "k", 1, "s", "w", 2), (1, a, 5, "k", 1, "s", "w", 2), (2, a + " tail", 6, "k", 1, "s", "w", 2), (3, b, 7, "k", 1, "s", "w", 2),
            (4, None, 8, None, None, None, None, None), (4, None, 8, None, None, None, None, None)]
    got = ngram_join.keep_one(rows(names, data))
    assert got.columns == rows(names, data).columns
    kept = sorted(map(tuple, got.collect()), key=lambda r: r[2])
    assert [r[2] for r in kept] in ([5, 7, 8, 8], [6, 7, 8, 8]) and set(kept) <= set(data)


def brute_quality(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {p for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(rows):
    texts = [*ODD, "a b c a b c a b", "x\ny\nx\n \n \n", "a b # | <>", "α β γ α β γ", "\x0b\x0c"]
    got = {r["doc_id"]: r for r in quality.quality_table(documents(rows, texts)).collect()}
    for i, t in enumerate(texts):
        q = got[i]
        assert (q["n_words"], q["word_chars"], q["n_symbols"], q["n_dup_lines"], q["n_repeat_words"]) == brute_quality(t), i
        n = brute_quality(t)
        assert got[i]["base_failed"] == (n[0] < 50 or 100 * n[4] > 50 * n[0])
    assert quality.quality_table(documents(rows, [])).count() == 0


def test_quality_on_documents_and_adaptive_fences(spark, rows):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in quality.op10_quality_rules(spark, SF).collect():
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute_quality(docs[r["doc_id"]])
    plain = [" ".join(f"word{(i * 31 + j * j) % 1000}" for j in range(80)) for i in range(80)]
    odd = plain[0].replace(" ", " | # ")
    table = documents(rows, [*plain, odd])
    kept = {r["doc_id"] for r in quality.quality_filter(table).collect()}
    assert kept == set(range(80))
    noisy = documents(rows, [p.replace(" ", " | # ") for p in plain], "xx")  # where signs are usual, they are no fault
    assert quality.quality_filter(noisy).count() == 80
    assert quality.quality_filter(table.withColumn("lang", F.lit(None).cast("string"))).count() == 80


def prose(rng, n=120):
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def test_quality_fences_come_from_the_groups(rows):
    import random

    rng = random.Random(3)
    signs = lambda share: " ".join(w + ("#" if rng.random() < share else "") for w in prose(rng))
    data = [(f"a{i}", signs(0.10), "en", "code") for i in range(150)] + [(f"b{i}", signs(0.02), "en", "news") for i in range(150)]
    data += [("code-mid", signs(0.6), "en", "code"), ("news-mid", signs(0.6), "en", "news")]
    table = rows("doc_id string, text string, lang string, source string", data)
    verdict = {r["doc_id"]: r["kept"] for r in quality.quality_table(table).collect()}
    # the same share of signs is usual in one source and not in the other, by nothing but their own quantiles
    assert verdict["code-mid"] and not verdict["news-mid"] and sum(verdict.values()) == 301


def test_quality_metrics_reject_and_junk_does_not_lift_fences(rows):
    import random

    rng = random.Random(6)
    clean = lambda: "\n".join(" ".join(prose(rng, 12)) for _ in range(10))
    junk = lambda: clean().replace(" ", " ### ")
    data = [(f"c{i}", clean(), "en", f"s{i % 5}") for i in range(500)]
    data += [(f"m{i}", clean(), "en", "mixed") for i in range(60)] + [(f"j{i}", junk(), "en", "mixed") for i in range(40)]
    data += [("dup", clean() + "\n" + "\n".join(f"line {k}" for k in range(12)) * 1 + ("\n" + "\n".join(f"line {k}" for k in range(12))), "en", "s0")]
    data += [("repeat", clean() + " " + " ".join(prose(random.Random(1), 40)) + " x " + " ".join(prose(random.Random(1), 40)), "en", "s0")]
    data += [("long words", " ".join("x" * 40 + w for w in prose(rng)), "en", "s0"), ("null", None, None, None)]
    table = rows("doc_id string, text string, lang string, source string", data)
    got = {r["doc_id"]: r for r in quality.quality_table(table).collect()}
    assert not [i for i in range(40) if got[f"j{i}"]["kept"]] and all(got[f"c{i}"]["kept"] for i in range(500)) and all(got[f"m{i}"]["kept"] for i in range(60))
    assert got["j0"]["failed_rules"] == ["symbol_share"] and got["dup"]["failed_rules"][0] == "dup_line_share"
    assert got["repeat"]["failed_rules"] == ["repeat_share"] and got["long words"]["failed_rules"] == ["word_length"]
    assert got["null"]["base_failed"] and not got["null"]["kept"]


def test_group_fences_decide_on_documents(spark, rows):
    """English documents of the given tables, labelled or without signs, and a source whose texts are as full of bars as some junk there."""
    at = "/root/testdata/sf0.1"
    quality_of = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{at}/labels.parquet").collect()}
    sign = F.col("text").rlike("[#*$%&|<>]")
    docs = spark.read.parquet(f"{at}/documents.parquet").where("lang = 'en'").select("doc_id", "text", "lang", "source")
    docs = docs.where(~sign | F.col("doc_id").isin([i for i, q in quality_of.items() if q == 0])).repartition(8)
    bars = F.concat_ws("\n", F.transform(F.split("text", "\n"), lambda x: F.when(F.length(x) % 2 == 0, F.regexp_replace(x, " ", " | ")).otherwise(x)))
    lists = docs.where(~sign & (F.size(F.split("text", "\n")) > 3) & (F.length("text") < 3000)).orderBy("doc_id").limit(250)
    both = docs.union(lists.select(F.col("doc_id") + 10**6, bars.alias("text"), "lang", F.lit("lists")))
    verdict = lambda **k: {r["doc_id"]: (r["base_failed"], r["kept"], r["source"]) for r in quality.quality_table(both, **k).collect()}
    own, corpus = verdict(), verdict(groups=())
    lists = [i for i in own if own[i][2] == "lists" and not own[i][0]]
    changed = [i for i in own if own[i][1] != corpus[i][1]]
    assert len(lists) > 200 and sum(own[i][1] for i in lists) > 0.9 * len(lists) and sum(corpus[i][1] for i in lists) < 0.2 * len(lists)
    assert len(changed) > 0.7 * len(lists) and all(own[i][1] for i in changed)
    assert all(own[i][1] == bool(q) for i, q in quality_of.items() if i in own and not own[i][0])


def test_what_is_allowed_grows_with_the_text(rows):
    import random

    rng = random.Random(8)
    clean = [(i, "\n".join(" ".join(prose(rng, 12)) for _ in range(10)), "en", "s") for i in range(200)]
    signs = lambda words, n: " ".join(w + ("#" if i < n else "") for i, w in enumerate(prose(rng, words)))
    odd = [(1000, signs(20_000, 7), "en", "s"), (1001, signs(20_000, 60), "en", "s"), (1002, signs(20_000, 4_000), "en", "s"), (1003, signs(120, 60), "en", "s")]
    got = {r["doc_id"]: r["kept"] for r in quality.quality_table(rows("doc_id long, text string, lang string, source string", clean + odd)).collect()}
    assert all(got[i] for i in range(200)) and got[1000] and got[1001] and not got[1002] and not got[1003]


def test_quality_keeps_clashing_columns(rows):
    names = "doc_id long, text string, lang string, source string, kept string, doc int, q int, fence string, n_words string"
    table = rows(names, [(1, " ".join(f"w{i}" for i in range(99)), "en", "s", "mine", 1, 2, "f", "n"), (2, "", None, None, None, None, None, None, None)])
    rated = quality.quality_table(table).collect()
    assert {r["doc_id"]: (r["kept"], r["n_words"]) for r in rated} == {1: (True, 99), 2: (False, 0)}
    back = quality.quality_filter(table)
    assert back.columns == table.columns and [(r["kept"], r["doc"], r["fence"], r["n_words"]) for r in back.collect()] == [("mine", 1, "f", "n")]


def test_pages_on_disk(spark):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in html.op2_html_extraction(spark, SF).collect():
        inner = re.search("<article>(.*?)</article>", pages[r["page_id"]], re.S)[1]
        blocks = [" ".join(html_lib.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split("</?p>|</?h1>", inner.replace("<br>", " "))]
        assert r["text"] == "\n".join(filter(None, blocks)) and r["n_chars"] == len(r["text"])


def test_chat_query_on_conversations(spark):
    turns = defaultdict(list)
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        turns[r["conv_id"]].append((r["turn"], r["role"] or "", r["text"] or ""))
    turns[-7] = [(0, "user", chat.PROBE), (1, "assistant", chat.PROBE)]
    got = {r["conv_id"]: r for r in chat.op4_chat_format(spark, SF).collect()}
    assert got.keys() == turns.keys() and -7 in got
    for i, rows_ in turns.items():
        ordered = [(role, text) for _, role, text in sorted(rows_)]
        loss = "".join(text for role, text in ordered if role == "assistant")
        assert got[i]["n_turns"] == len(ordered) and got[i]["loss_chars"] == len(loss)
        assert got[i]["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in ordered).encode()).hexdigest()
        assert got[i]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()


def test_chat_odd_input(rows):
    names = "conv_id long, turn long, role string, text string, turns string, formatted int"
    assert chat.format_conversations(rows(names, [])).count() == 0
    long = "word " * 100_000
    got = chat.digest(chat.format_conversations(rows(names, [(1, 0, None, None, "t", 1), (1, 1, "assistant", long, "t", 1), (None, 0, "assistant", "x", "t", 1)]))).collect()
    assert {r["conv_id"]: (r["n_turns"], r["loss_chars"]) for r in got} == {1: (2, len(long)), None: (1, 1)}


def test_packing_query_on_documents(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    ids = {i: plain.encode(t, add_special_tokens=False).ids + [0] for i, t in texts.items()}
    pieces, fill = defaultdict(list), defaultdict(list)
    for r in packing.op5_packing(spark, SF).collect():
        pieces[r["doc_id"]].append((r["start"], r["length"]))
        fill[r["sequence_id"]].append((r["offset"], r["length"]))
        want = np.array(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4").tobytes()
        assert r["ids_crc32"] == zlib.crc32(want) and r["doc_tokens"] == len(ids[r["doc_id"]]) and r["length"] > 0
    for i, found in pieces.items():
        at = 0
        for start, length in sorted(found):
            assert start == at
            at += length
        assert at == len(ids[i])
    assert pieces.keys() == ids.keys()
    for found in fill.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= 1024


def test_topk_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    assert sorted(map(tuple, topk.op1_exact_topk(spark, SF).collect())) == sorted(con.execute(topk.OP1_SQL).fetchall())


def test_pipeline(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, tables = docs.columns, Stages(spark, "test_pipeline")
    counts = [docs.count()]
    for name, stage in cp.STAGES[:-1]:
        before, docs = docs, tables.table(stage(spark, docs, SF))
        assert docs.columns == columns
        counts.append(docs.count())
        if name == "quality_rules":
            want = {r["doc_id"] for r in quality.op10_quality_rules(spark, SF).where("kept").collect()}
            assert {r["doc_id"] for r in docs.collect()} == want
        if name == "ngram_join":
            n = brute_components([(i, r["text"]) for i, r in enumerate(before.collect())])
            empty = sum(1 for size, _ in n.values() if not size)
            assert docs.count() == len({c for s, c in n.values() if s}) + empty
    assert counts[1] < counts[0] and counts[2] <= counts[1] and counts[3] <= counts[2]
    packed = cp.run(spark, SF)
    sizes = {}
    for r in packed.select("doc_id", "doc_tokens", "start", "length", "sequence_id").collect():
        assert r["length"] > 0
        sizes.setdefault(r["sequence_id"], 0)
        sizes[r["sequence_id"]] += r["length"]
    assert all(s == 1024 or s.bit_count() == 1 for s in sizes.values())


def test_entry_without_the_pipeline_file(monkeypatch):
    import sys

    import __spark_entry__ as entry

    for name in [n for n in sys.modules if n.startswith("quern.llm.registry") or n == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    with pytest.raises(ModuleNotFoundError):
        import quern.llm.registry  # noqa: F401
    assert "hybrid_search" in entry.queries()
