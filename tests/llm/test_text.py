"""BPE against the tokenizers library, language ID by held-out accuracy, personal data and pages by hand and brute force."""

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillspark.llm import queries
from quillspark.llm.bpe import Decoder, Encoder, Vocabulary, bpe_decode, bpe_encode
from quillspark.llm.html_extract import TAG, TEXT, deduce_templates, extract_main_text, main_text, packed_page, page_tokens
from quillspark.llm.language_id import identify_language, train_language_model
from quillspark.llm.sanitise import KINDS, base_spans, disclosing_terms, find_base, personal_data, redacted

SF = "/root/testdata/sf0.001"
ODD = [
    "", " ", "Hello, World!", "don't we'll I'VE", "ÀÉÎ é İ ΣαΣ", "<|startoftext|>x<|endoftext|> y <|STARTOFTEXT|>",
    "日本語テキスト 12345 ٣٤", "a b　c\x1cd\x1de\x85f​g", "👩‍👩‍👧 🙂🙂", "x" * 5000, "ab" * 3000 + " " + "!?" * 2000, "\r\n\t tabs\x0b\x0c", "'s't 're'", "naïve café's", "0½Ⅷ", "각", "\x00\x01\x7f", "<|endoftext|><|endoftext|>",
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.vocabulary_path())
    t.no_truncation()
    t.no_padding()
    return t


def digests(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_matches_library_on_odd_texts(spark, library):
    docs = spark.createDataFrame(list(enumerate([*ODD, None])), "doc_id long, text string")
    rows = bpe_decode(bpe_encode(docs, queries.vocabulary_path()), queries.vocabulary_path()).collect()
    for r in rows:
        ids = list(struct.unpack(f"<{len(r['ids']) // 4}I", r["ids"]))
        assert ids == library.encode(r["text"] or "", add_special_tokens=False).ids, r["text"]
        assert r["decoded"] == library.decode(ids, skip_special_tokens=False)


def test_bpe_query_matches_library(spark, library):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    rows = queries.op4_bpe(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == digests(library, texts[r["doc_id"]])


def test_bpe_streams_like_whole_texts(library):
    v = Vocabulary.read(queries.vocabulary_path())
    for text in ["the quick brown fox " * 50 + "end<|endoftext|>more words", "y" * 3000 + " tail", "".join(ODD)]:
        want = library.encode(text, add_special_tokens=False).ids
        for size in (7, 64, 4096):
            got = b"".join(Encoder(v).encode(text[k : k + size] for k in range(0, len(text), size)))
            assert list(struct.unpack(f"<{len(got) // 4}I", got)) == want


def test_bpe_holds_little_of_words_without_end(library):
    v, rng = Vocabulary.read(queries.vocabulary_path()), random.Random(5)
    parts = [*"abcSTLlre!!-19éÉ́ñΣ漢각", "'", "'", "'s", "'LL", "<|endoftext|>", "<|", " "]
    for _ in range(400):
        some = rng.sample(parts, rng.randint(1, 12))
        text = "".join(rng.choice(some) for _ in range(rng.randint(0, 300)))
        size = rng.randint(1, 50)
        got = b"".join(Encoder(v, hold=rng.choice([8, 30])).encode(text[k : k + size] for k in range(0, len(text), size)))
        assert list(struct.unpack(f"<{len(got) // 4}I", got)) == library.encode(text, add_special_tokens=False).ids, text
    for unit in "a!'":
        held = []
        encoder = Encoder(v, hold=1000)

        def watched(text):
            held.append(len(text))
            return text

        encoder._normal = lambda text, make=encoder._normal: make(watched(text))
        for _ in encoder.encode(unit * 500 for _ in range(100)):
            pass
        assert max(held) <= 1500


def test_bpe_decodes_bytes_back():
    v = Vocabulary.read(queries.vocabulary_path())
    text = "plain words and 日本 and ñ"
    ids = [i for (i,) in struct.iter_unpack("<I", b"".join(Encoder(v).encode([text])))]
    machine = Decoder(v, joined=False)
    assert ("".join(machine.feed([i]) for i in ids) + machine.close()).split() == text.split()


def test_language_id_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    found = queries.op5_language_id(spark, sf)
    truth = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    rows = found.join(truth, "doc_id").filter("held_out and lang is not null and lang_pred <> 'und'").select("lang", "lang_pred", "score").collect()
    assert len(rows) > 200 and sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.95 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)


def grams_by_force(text, buckets=1 << 15):
    """Buckets of all 1-, 2- and 3-grams of a text's lower-cased letters, with one blank for anything else."""
    mask, out = (1 << 64) - 1, []
    chars = " " + re.sub(r"[\W\d_]+", " ", text.lower()).strip(" ") + " "
    for n in (1, 2, 3):
        for i in range(len(chars) - n + 1):
            x = n
            for c in chars[i : i + n]:
                x = (x * 0x100000001B3 + ord(c)) & mask
            x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & mask
            x = ((x ^ x >> 27) * 0x94D049BB133111EB) & mask
            out.append((x ^ x >> 31) % buckets)
    return out


def test_language_query_matches_plain_bayes(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()
    counts, docs = {}, Counter()
    for r in rows:
        if zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1 and r["text"] is not None and r["lang"] is not None:
            counts.setdefault(r["lang"], Counter()).update(grams_by_force(r["text"]))
            docs[r["lang"]] += 1
    totals = {x: sum(own.values()) for x, own in counts.items()}
    got = {r["doc_id"]: r for r in queries.op5_language_id(spark, SF).collect()}
    assert len(got) == len(rows)
    for r in rows:
        mine, text = got[r["doc_id"]], r["text"] or ""
        assert mine["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        if not any(map(str.isalpha, text)):
            assert (mine["lang_pred"], mine["score"]) == ("und", 0)
            continue
        grams = Counter(grams_by_force(text))
        like = {x: math.log(docs[x] / sum(docs.values())) + sum(k * math.log((own[g] + 0.5) / (totals[x] + 0.5 * (1 << 15))) for g, k in grams.items()) for x, own in counts.items()}
        best = max(sorted(like), key=like.get)
        assert mine["lang_pred"] == best and abs(mine["score"] - 1 / sum(math.exp(v - like[best]) for v in like.values())) < 1e-3


def test_language_id_small(spark):
    model = train_language_model(spark.createDataFrame([("the cat and the dog", "en"), ("der Hund und die Katze", "de"), (None, "en"), ("x", None)], "text string, lang string"))
    assert model.langs == ["de", "en"]
    docs = spark.createDataFrame([("the dog", 1), ("UND DER HUND", 2), (None, 3), ("12 34 !", 4), ("", 5)], "text string, _p int").withColumn("score", F.lit("old"))
    got = {r["_p"]: r for r in identify_language(docs, model).collect()}
    assert [got[k]["lang_pred"] for k in range(1, 6)] == ["en", "de", "und", "und", "und"] and got[3]["score"] == 0
    empty = train_language_model(spark.createDataFrame([], "text string, lang string"))
    assert {r["lang_pred"] for r in identify_language(docs, empty).collect()} == {"und"}


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


def spans_by_force(text):
    out = []
    for kind in KINDS:
        for m in re.finditer(PATTERNS[kind], text):
            digits = re.sub("[^0-9]", "", m.group())
            good = {"email": True, "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else True, "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if good:
                out.append((kind, *m.span()))
    return out


PERSONAL = [
    "mail a.b+c@x-y.co.uk, a@b@c.de, @x.y, q@r, .@d.e a@b.c.@d.e", "1.2.3.4.5.6.7.8 256.1.1.1 1.2.3 01.002.3.255 9.9.9.9.9", "4111 1111-1111 1111 and 4111111111111112, 4111  1111", "+49 (0)30 123456 +1.2 +123456789012345678 ++44 20 7946 0958", "é+33 1 23 45 67 89é x@y.zé",
]


def test_base_spans_match_patterns():
    for text in PERSONAL:
        got = [(k, a, b) for k in KINDS for a, b in base_spans(text)[k]]
        assert got == spans_by_force(text), text


def test_personal_data_query_keeps_base_spans(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    rows = queries.op10_personal_data(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = spans_by_force(texts[r["doc_id"]])
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in KINDS] == [sum(w[0] == k for w in want) for k in KINDS]
        assert (r["spans"] + ",").startswith(joined and joined + ",")


def test_terms_that_disclose_are_marked(spark):
    rare = [f"case{chr(97 + k)} xanthippe wrote via x@secret.org today nr {k}" for k in range(6)]
    plain = [f"the weather was fine and today we walked far, part {k}" for k in range(60)]
    other = ["only xanthippe here", "nothing to see", None, "", "copy x@secret.org"]
    texts = rare + plain + other
    rows = {r["doc_id"]: r["spans"] for r in personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    marked = {texts[i][s["start"] : s["end"]] for i, own in rows.items() for s in own if s["kind"] == "term"}
    assert "xanthippe" in marked and "today" not in marked and "the" not in marked
    assert [(s["kind"], s["start"], s["end"]) for s in rows[66]] == [("term", 5, 14)] and rows[68] == [] and rows[69] == []
    # copies of one passage are one piece of evidence
    copies = spark.createDataFrame([(k, "xanthippe wrote via x@secret.org today") for k in range(50)] + [(99, "else")], "doc_id long, text string")
    assert personal_data(copies).select(F.explode("spans").alias("s")).filter("s.kind = 'term'").isEmpty()


def test_copied_documents_do_not_hide_a_disclosing_term(spark):
    rare = [f"case{chr(97 + k)} xanthippe wrote via x@secret.org today nr {k}" for k in range(6)]
    texts = rare + [f"the weather was fine and today we walked far, part {k}" for k in range(60)] + [rare[0]] * 200
    rows = personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    marked = {texts[r["doc_id"]][s["start"] : s["end"]] for r in rows for s in r["spans"] if s["kind"] == "term"}
    assert "xanthippe" in marked and "today" not in marked


def test_context_reaches_the_window_over_any_distance(spark):
    docs = spark.createDataFrame([(1, "alpha " + "- " * 150 + "x@secret.org" + " 7" * 150 + " omega")], "doc_id long, text string")
    assert find_base(docs, "doc_id", "text", 8).first()["mentions"][0]["terms"] == ["alpha", "omega"]


def disclosing_by_force(texts, window, disclosure):
    """Terms that reveal an entity, from contexts and counts of the whole corpus held in memory."""
    from math import log2, sqrt

    different, contexts = set(texts), {}
    for text in different:
        found = base_spans(text)
        flat = list(text)
        for own in found.values():
            for a, b in own:
                flat[a:b] = " " * (b - a)
        places = [(m.start(), m.end(), m.group().lower()) for m in re.finditer(r"[^\W\d_]{2,}", "".join(flat))]
        for kind, own in found.items():
            for a, b in own:
                left, right = [w for _, e, w in places if e <= a][-window:], [w for s, _, w in places if s >= b][:window]
                literal = text[a:b].lower()
                if kind in ("card", "phone"):
                    literal = re.sub(r"[ ().-]", "", literal)
                owner = {"email": literal.split("@")[-1], "ip": literal[: literal.rfind(".")]}.get(kind, literal[:6])
                for entity in ((kind, literal), ("owner", kind, owner), ("kind", kind)):
                    contexts.setdefault(entity, set()).add((tuple(left), tuple(right)))
        if any(found.values()) and places:
            contexts.setdefault("document", set()).add((text, tuple(sorted({w for _, _, w in places}))))
    n, out = len(different), set()
    df = Counter(w for text in different for w in {m.lower() for m in re.findall(r"[^\W\d_]{2,}", text)})
    for entity, own in contexts.items():
        both = Counter(w for c in own for w in ({*c[0], *c[1]} if entity != "document" else c[1]))
        content = log2(n / len(own))
        for w, k in both.items():
            low = k * (1 - 1 / (9 * k) - 1.645 / (3 * sqrt(k))) ** 3 if entity == "document" or entity[0] in ("owner", "kind") else k - 1
            if content > 0 and k > 1 and log2(low * n / (len(own) * max(df[w], k))) >= disclosure * content:
                out.add(w)
    return out


def test_disclosing_terms_match_brute_force(spark):
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefgh") for _ in range(3)) for _ in range(120)]
    texts = [" ".join(rng.choices(words, k=rng.randint(3, 40))) for _ in range(400)]
    for k in range(40):
        kind = rng.choice([f"u{k}@corp.example", "10.0.0.%d" % k, "+1 (555) 010-%04d" % k])
        texts[k] = f"{texts[k]} ledger {kind} {rng.choice(['xylo', 'quince'])} {texts[-k - 1]}"
    texts += texts[:30] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    mentions = find_base(docs, "doc_id", "text", 8).select(F.explode("mentions").alias("m")).select("m.*")
    got = {r["term"] for r in disclosing_terms(mentions, docs, "text", 0.8).collect()}
    assert got == disclosing_by_force(texts, 8, 0.8) and "ledger" in got


def test_redaction(spark):
    rows = spark.createDataFrame([("ask Ann at a@b.cd now", [("email", 11, 17), ("term", 4, 7)]), (None, None)], "text string, spans array<struct<kind:string,start:long,end:long>>")
    assert [r["sanitised"] for r in redacted(rows).collect()] == ["ask  at [EMAIL] now", ""]


def page(body, k):
    return f"<html><head><title>T{k}</title><style>p {{}}</style></head><body><div class='top'><p>Welcome to the daily site</p><p>All the news of today</p><p>Call us at any time</p></div><nav><a>Home</a></nav>{body}<div class='low'><p>Made with care</p></div><footer>(c)</footer><script>var x = '<p>no</p>'</script></body></html>"


def test_pages(spark):
    rows = [(k, "http://h.example/a%d" % k, page(f"<div class='story'><h1>Story {k}</h1><p>First&nbsp;part  of\n{k} &amp; more</p><p>Second <b>part</b> {'x' * k}</p></div>", k)) for k in range(8)]
    rows += [(20, None, None), (21, "odd", ""), (22, "http://o.example/", "<article><h2>A &lt; B</h2><p>one<p>two<ul><li>x<li>y</ul></article><div id='comments'><p>me first</p></div><aside>ad</aside>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"_host": F.lit(1), "_template": F.lit(2), "text": F.lit("old")})
    got = {r["page_id"]: r for r in extract_main_text(pages).collect()}
    assert len(got) == len(rows) and got[3]["_host"] == 1 and got[3]["_template"] == 2
    for k in range(1, 8):
        assert got[k]["text"] == f"Story {k}\nFirst part of {k} & more\nSecond part {'x' * k}"
    assert got[20]["text"] == got[21]["text"] == "" and got[22]["text"] == "A < B\none\ntwo\nx\ny"


def test_pages_query(spark):
    rows = queries.op9_html_extraction(spark, SF).collect()
    pages = spark.read.parquet(f"{SF}/pages.parquet").count()
    assert len(rows) == pages and all(r["n_chars"] == len(r["text"]) for r in rows)
    assert sum(r["n_chars"] > 0 for r in rows) > 0.5 * pages


def test_template_alone_finds_the_article(spark):
    """Without any tag or name as a hint, slots of the deduced template are the article, and furniture without names goes."""
    rows = [(k, "http://h.example/%d" % k, f"<html><body><div><p>Welcome to us</p><p>All the news</p><ul><li><a>Home</a><li><a>About</a></ul></div><div><h1>Story {k}</h1><p>Part {k * k}</p></div><div><p>Made with care</p></div></body></html>") for k in range(1, 9)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for r in extract_main_text(pages, hints=False).collect():
        assert r["text"] == f"Story {r['page_id']}\nPart {r['page_id'] ** 2}"


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<body><div class='layout has-sidebar'><h1>A</h1><p>b</p></div></body>", "A\nb"),
        ("<body><div class='article-header'><h1>Headline</h1></div><article><p>one</p></article></body>", "Headline\none"),
        ("<body><article><p>teaser</p></article><div class='story'><p>the story</p></div></body>", "teaser\nthe story"),
        ("<body><div class='intro'><p>short</p></div><div class='body'><p>much longer text of the page</p></div></body>", "short\nmuch longer text of the page"),
        ("<body><article><p>x</p></article><div class='post-comments'><p>me first</p></div><nav>n</nav><div class='site-header'>s</div></body>", "x"),
        ("", ""),
        (None, ""),
        ("<![x<p>q</p>", "q"),
        ("<p>a</p><!", "a"),
        ("<p>a</p><![", "a"),
        ("<p>a</p><![CDATA[x<p>b", "a"),
        ("<![if !IE]><p>w</p><![endif]>", "w"),
        ("<p>k<!-- open <p>x", "k"),
        ("<p>a<b class='", "a"),
        ("<?x <p>z</p>", "z"),
        ("a < b</", "a < b</"),
    ],
)
def test_single_pages(html, want):
    assert main_text(packed_page(html)) == want


def test_form_around_the_page_is_no_furniture(spark):
    rows = [(k, "http://f.example/%d" % k, f"<body><form><nav><a>Home</a></nav><h1>Title {k}</h1><p>{'text ' * k}</p><div class='comments'><p>{'reply ' * 40}{k}</p></div></form></body>") for k in range(5, 9)]
    got = extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all(r["text"] == f"Title {r['page_id']}\n" + ("text " * r["page_id"]).strip() for r in got)


def test_deep_and_broken_pages_in_a_table(spark):
    rows = [(1, "http://d.example/", "<nav>" * 8000 + "menu" + "</nav>" * 8000 + "<p>text"), (2, "http://d.example/b", "<![x<p>q</p>"), (3, "http://d.example/c", "<!")]
    got = {r["page_id"]: r["text"] for r in extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "text", 2: "q", 3: ""}


def templates_by_force(pages, min_pages, min_share, min_tokens):
    """host -> template texts, straight from the definition of classes over occurrence vectors."""
    out = {}
    for host in {h for h, _ in pages}:
        own = {fp: toks for fp, toks in (page_tokens(html) for h, html in pages if h == host)}
        counts = {}
        for fp, toks in own.items():
            for t, kind, n, place in toks:
                if kind in (TAG, TEXT):
                    counts.setdefault((t, kind), {})[fp] = (n, place)
        classes = {}
        for key, seen in counts.items():
            if len(seen) >= max(min_pages, min_share * len(own)):
                classes.setdefault(tuple(sorted((fp, n) for fp, (n, _) in seen.items())), []).append((key, seen))
        for group in classes.values():
            tags = sorted((min(p for _, p in seen.values()), max(p for _, p in seen.values())) for (_, kind), seen in group if kind == TAG)
            if len(group) >= min_tokens and [t[1] for t in tags] == sorted(t[1] for t in tags):
                out.setdefault(host, set()).update(t for (t, kind), _ in group if kind == TEXT)
    return {h: v for h, v in out.items() if v}


def test_templates_match_brute_force(spark):
    pages = [(f"h{k % 3}", page(f"<div class='story'><h1>S {k}</h1><p>{'w ' * (k % 5)}{k}</p>{'<p>Now and then</p>' * (k % 2)}</div>", k % 4)) for k in range(30)]
    table = spark.createDataFrame(pages, "host string, html string")
    got = {r["host"]: set(r["template"]) for r in deduce_templates(table, "host", "html", 4, 0.6, 3).collect()}
    assert {h: v for h, v in got.items() if v} == templates_by_force(pages, 4, 0.6, 3) and got
