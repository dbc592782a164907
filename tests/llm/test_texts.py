"""Splitting, restoring, cleaning, encoding and mixing on small fixtures."""

import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm import bpe, mojibake
from lectern.llm.markup import LABELS, LANGS, Model, analyse, clean, labelled, model, training_pages
from lectern.llm.mixing import Mix, apportion
from lectern.llm.splitting import boundaries, pieces, split_oversized

_KINDS = ["markdown", "text", "html", "code", "csv", "json", "xml", "yaml", "pdf", None]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .,\n\r。、#=<p>\u0301\u200d日", max_size=300), st.sampled_from(_KINDS), st.integers(1, 40), st.integers(-2, 50))
def test_pieces_lose_nothing(text, kind, most, overlap):
    got = pieces(text, kind, most, overlap)
    over = min(max(0, overlap), most - 1)
    assert got[0][0] == 0 and got[-1][1] == len(text) and all(e - s <= most for s, e in got)
    assert all(b[0] == a[1] - over and b[0] > a[0] and b[1] > a[1] for a, b in zip(got, got[1:]))
    if len(text) > most:
        assert text == text[: got[0][1]] + "".join(text[a[1] : b[1]] for a, b in zip(got, got[1:]))


def test_cuts_lie_at_the_strongest_boundary():
    text = ("One sentence here. " * 5 + "\n\n") * 6
    cut = pieces(text, "text", 230, 20)
    assert all(text[e - 2 : e] == "\n\n" for _, e in cut[:-1])
    code = "".join(f"def f{i}(x):\n    y = x + {i}\n    return y\n\n" for i in range(20))
    assert all(code[e:].startswith("def") for _, e in pieces(code, "code", 200, 10)[:-1])
    rows = "".join(f"a | {i} | c\n" for i in range(100))
    assert all(rows[e - 1] == "\n" for _, e in pieces(rows, "csv", 150, 0)[:-1])
    at, strength = boundaries("", "text")
    assert len(at) == len(strength) == 0


def test_a_boundary_inside_the_overlap_is_no_cut():
    text = "# Head\n\n" + "word " * 400
    got = pieces(text, "markdown", 900, 300)
    assert got[0][1] > 300 and all(0 <= s < e for s, e in got)
    assert text == text[: got[0][1]] + "".join(text[b[0] : b[1]][a[1] - b[0] :] for a, b in zip(got, got[1:]))


def test_split_table(spark):
    rows = [(1, "text", "x y. " * 100, 1), (2, "text", "short", 1), (3, "text", None, 1), (4, "nolimit", "z" * 999, 1), (5, None, "z" * 999, 1), (6, "text", "", 1)]
    texts = spark.createDataFrame(rows, "file_id long, kind string, content string, max_chars int")
    limits = spark.createDataFrame([("text", 120, 15), ("nolimit", None, 3), (None, 5, 1)], "kind string, max_chars int, overlap_chars int")
    got = split_oversized(texts, limits).orderBy("file_id", "piece_no").collect()
    assert {r.file_id for r in got} == {1} and [r.piece_no for r in got] == list(range(1, got[0].n_pieces + 1))
    assert all(r.piece == rows[0][2][r.start : r.end] for r in got)
    assert split_oversized(texts.limit(0), limits).count() == 0


WORDS = "Größe für Straße Prüfliste gezählt überflüssig Lüfter Gehäuse schließt Änderung".split()


def test_garbled_files_are_found_and_restored(spark):
    r = random.Random(2)
    clean = [" ".join(r.choice(WORDS) for _ in range(30)) for _ in range(60)]
    zh = ["系统每天移动打印机，然后检查目录。请先读取文件夹，再恢复快照。" * 2] * 30
    bad = {
        900: (WORDS[0] + " " + " ".join(WORDS)).encode().decode("cp1252", "replace"),
        901: " ".join(WORDS).encode("cp1252").decode("mac_roman"),
        902: "plain words " + zh[0].encode().decode("latin-1"),
        903: zh[0].encode("gb18030").decode("cp1252", "replace"),
        904: " ".join(WORDS).encode().decode("cp437"),
        905: " ".join(WORDS).encode().decode("latin-1").encode().decode("latin-1"),
        906: " ".join(WORDS).encode("cp1252").decode("utf-8", "replace"),
    }
    fine = {1000: "vodra\n├── notes\n│   └── x.txt", 1001: "ﾌｧｲﾙ ﾊﾞｯｸｱｯﾌﾟ 27", 1002: "SEÇÃO 3: CORREÇÃO", 1003: "", 1004: "only ASCII", 1005: None}
    rows = [(i, t) for i, t in enumerate(clean + zh)] + list(bad.items()) + list(fine.items())
    df = spark.createDataFrame(rows, "file_id long, content string")
    got = {x.id: x for x in mojibake.Garbled(df, most_bits=20).restored().collect()}
    assert set(got) == set(bad)
    assert got[901].restored == got[904].restored == got[905].restored == " ".join(WORDS)
    assert got[902].restored == "plain words " + zh[0]
    assert mojibake.Garbled(df.limit(0), most_bits=16).restored().count() == 0


def test_markup_model_on_held_out_pages():
    made = [labelled(p) for p in training_pages(60, 4242)]
    got = [x for own in model().labels([p for p, _ in made]) for x in own]
    gold = [x for _, labels in made for x in labels]
    assert sum(LABELS[a] == b for a, b in zip(got, gold, strict=True)) / len(gold) > 0.98


#: Lines of the library, labelled by hand with the languages they hold (h, m, w, l).
BY_HAND = [
    ("Please compare fengilwil_map.pdf with the portable backup on 2021-02-27.", ""), ("gilholun_size_218 and __ are names", ""), ("Xayor: a < 294 and b > 298, else a == 294", ""),
    ("Mapra costs $6 to $56, R&D & more.", ""), ("C:\\Users\\sojorel\\temp\\519.log", ""), ("use <narcorsa-folder> as the target, see [28]", ""), ("Yorzen [A-889] {889} ~889 min", ""),
    ("Ticket #413 and #420 are about Hoin.", ""), ("* Três lições: lição, estação, máquina (útil).", ""), ("+ Entre contraseña y espacio hay 245 señales de Selnar.", ""), ("索引 & Pradel & 413 \\\\", ""),
    ("详见kabritri_table.csv，里面写了怎样恢复fibotri。", ""), ("A coleзгo Nezaval nгo recomeзou reuniгo atй 2020-08-22.", ""), ("Dbelfizen_table.csv‚ðŒ©‚ê‚Î�ARiquiso‚ª‚Ç‚¤•_ƒtƒHƒ‹ƒ_‚ð•œŒ³‚·‚é", ""),
    ("Relkel événement recette\n========================", "m"), ("Tafen brouillon étape\n---------------------", "m"), ("| relevé | Kaho | 767 |\n|---|:--|--:|\n| modèle | Relnefi | 974 |", "m"), ("```sh\ntacorxa --selfikel 135\n```", "m"),
    ("~~~\nlunbo --vomel 462\n~~~", "m"), ("- [ ] La sección 729 explica cómo Dadra cambió cada niñez.", "m"), ("Según delwiltel-list.yaml, reunión ~~sigue útil~~ y reunión no.", "m"), ("- ¿Quién leyó [tamaño](docs/bohobe.md) si Mivalta está válido?", "m"),
    ("gráfico `no. El 2024-07-21,` T.F contó 241 páginas", "m"), ("# Valho 说明书账本 #", "m"), ("只`有A.D知道`Lunbrizen为什么会打印缩略图。", "m"), ("> 全部で66枚、フォルダ、印刷機、予定表の順です。", "m"), ("when Norkelval __is slow and the__ survey is portable", "m"), ("![Hoxakel](img/hoxakel.png)", "m"),
    ("== Calmelba worksheet archive ==", "w"), ('{| class="wikitable"\n|-\n| checklist || Delselza || 408\n|}', "w"), ("A reader without a {{note|survey imports}} Indane17 at all", "w"), ("Last remote notebook: Draka. [[File:Xane.png|thumb]]", "w"), ("opens Relsa at all is still open. [[Ingar#Venquiin]]s", "w"),
    ("* Melnefi wählt jeden [[Peltel|Abend 382 Stücke]] und druckt den Rest.", "w"), ("{{math|a = 34}}", "w"), ("* Mellorel ersetzt ''jeden'' Abend 67 Stücke.", "w"), ("=== Garvenvo manual manual ===", "w"),
    ("\\section*{Jori}", "l"), ("There were 97 pages about Relgilne, mostly missing. \\textit{Holun}", "l"), ("missing and the receipt is slow. $n^2 + j^2 \\le 23$", "l"), ("aber Änderung schon günstig. \\(z_{r} = 8r\\)", "l"), ("$$\nz^2 + r^2 \\le 47\n$$", "l"), ("$$\\sum_{v=1}^{38} a_v^2$$", "l"), ("K.N wrote. \\alpha_{3} \\times \\beta", "l"),
    ('<div class="sohodel">第106步：改名账本。</div>', "h"), ("这一点B.M已经说明。&nbsp;&mdash; Neracor</p>", "h"), ("<!DOCTYPE html>", "h"), ("<li>如果硬盘看起来是安静的，就不要重建备份。</li>", "h"), ("lunwilbo --x 791</code></pre>", "h"), ("the remote quota. <a\nhref='yorwil.html'>Yorwil</a>", "h"), ("<sub>Wilsarel</sub>", "h"), ("<p><i>x</i><sup>2</sup> &le; 54</p>", "h"),
    ("<p>\\(x_q = \\frac{38}{q+1}\\)</p>", "hl"), ("## Brielhal38 收据草稿 ##\n\n一共有[43个说明](docs/fensobe.md)书。<br/>", "hm"), ("Keep Relxa away [[Delfirel|from the]] printer.<br />", "hw"),
]


def test_markup_model_on_lines_labelled_by_hand():
    names = dict(zip("hmwl", LANGS, strict=True))
    wrong = []
    for (text, langs), (_, _, mask) in zip(BY_HAND, analyse([t for t, _ in BY_HAND], model()), strict=True):
        if {g for i, g in enumerate(LANGS) if mask >> i & 1} != {names[c] for c in langs}:
            wrong.append(text)
    assert len(wrong) <= 1, wrong


def test_the_model_decides():
    """An untrained field finds nothing: no pattern stands beside the model."""
    from lectern.llm.crf import CRF

    blank = Model(model().names, CRF(len(model().names), len(LABELS)))
    assert not any(mask for _, _, mask in analyse([t for t, _ in BY_HAND], blank))


def test_deep_and_long_documents():
    deep = "<div>" * 3000 + "x" + "</div>" * 3000
    (_, labels, mask), (_, none, empty) = analyse([deep, ""], model())
    assert mask == 1 and len(labels) == 6001 and not none and not empty


@pytest.mark.parametrize(
    ("text", "langs"),
    [
        ("Plain *5 * 6 costs $5 to $10, C:\\Users\\temp, see [9] and #12, my_own_name, <badra-folder>, a < 5 and b > 3", set()),
        ("- one\n- two\n1. three", set()),
        ("", set()),
        ("## Title here\n\nText.", {"markdown"}),
        ("Title\n=====\n\ntext", {"markdown"}),
        ("some **bold** text", {"markdown"}),
        ("```\n<b>no tag</b> in code\n```", {"markdown"}),
        ("a<br/>b &nbsp; c", {"html"}),
        ("text &amp;lt; more", {"html"}),
        ("== Head ==\n\n''soft'' [[Link|shown]]", {"wiki"}),
        ("\\section{A}\n\nwith $x^2 + 1$ inside", {"latex"}),
        ("**b** and \\textit{c} and <i>d</i>", {"markdown", "latex", "html"}),
    ],
)
def test_markup_languages(text, langs):
    _, _, mask = analyse([text], model())[0]
    assert {g for i, g in enumerate(LANGS) if mask >> i & 1} == langs


def test_clean_text_keeps_structure():
    source = "<h2>Big &amp; bold</h2>\n<ul>\n<li>one</li>\n</ul>\n\n```\ncode *x*\n```\n\nsee **this** and $a^2$\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n== Wiki ==\n''soft'' [[Link|shown]]\n\nTitle\n=====\n\n\\section{A}\n\\begin{equation}\nx = 1\n\\end{equation}"
    page, labels, _ = analyse([source], model())[0]
    text = clean(page, labels)
    for part in ("## Big & bold", "- one", "```\ncode *x*\n```", "see this and $a^2$", "a | b\n1 | 2", "## Wiki", "soft shown", "# Title", "# A", "$x = 1$"):
        assert part in text, (part, text)
    assert "|---|" not in text and "=====" not in text and "begin" not in text


def test_ids_equal_the_public_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    if not os.path.exists(bpe.VOCABULARY):
        pytest.skip("no vocabulary here")
    own = tokenizers.Tokenizer.from_file(bpe.VOCABULARY)
    own.encode_special_tokens = True
    r = random.Random(1)
    pool = "abs'dtlvermAB 12\t\n  éß中文日本。、aaaa!!'’ 　👍🏽á"
    texts = ["".join(r.choice(pool) for _ in range(r.randrange(60))) for _ in range(800)] + ["", "'s''s I'll", "aaaaaaaaaaaa" * 9, "<|endoftext|>", "   ", "x" * 3000, "\n \n"]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)] + [(-1, None, "c")], "doc_id long, text string, ids string")
    got = {x.doc_id: x.ids for x in bpe.token_ids(df, "doc_id", "text", chunk_chars=2000).collect()}
    assert got.pop(-1) == [] and got == {i: own.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts)}
    counts = {x.doc_id: x.n_tokens for x in bpe.token_counts(df, ["doc_id"], "text").collect()}
    assert counts == {i: len(v) for i, v in got.items()} | {-1: 0}
    assert bpe.token_ids(df.limit(0), "doc_id", "text").count() == 0


def test_apportionment_is_sainte_lague():
    assert apportion({"a": 0.53, "b": 0.24, "c": 0.23}, 7, {"a": 9, "b": 9, "c": 9}) == {"a": 3, "b": 2, "c": 2}
    assert apportion({"a": 0.5, "b": 0.5}, 10, {"a": 2, "b": 99}) == {"a": 2, "b": 8}
    assert apportion({}, 3, {}) == {}
    shares = {"a": 0.0333, "b": 0.0333, "c": 0.0333, "d": 0.9001}
    for seats in (4000, 8 * 500, 123_457):
        got = apportion(shares, seats, dict.fromkeys(shares, 10**9))
        assert sum(got.values()) == seats and all(abs(got[n] - s * seats) < 1 for n, s in shares.items())
    r = random.Random(6)
    for _ in range(60):  # seat by seat
        shares = {str(i): r.choice([0.5, 0.25, r.random(), 0.0]) for i in range(r.randint(1, 6))}
        left = {n: r.randint(0, 30) for n in shares}
        seats, want = r.randint(0, 60), dict.fromkeys(shares, 0)
        for _ in range(seats):
            free = [n for n in shares if want[n] < left[n] and shares[n]]
            if free:
                want[min(free, key=lambda n: (-shares[n] / (2 * want[n] + 1), n))] += 1
        assert apportion(shares, seats, left) == want


def test_mix(spark):
    if not os.path.exists(bpe.VOCABULARY):
        pytest.skip("no vocabulary here")
    r = random.Random(3)
    rows = [(i, " ".join(f"word{r.randrange(99)}" for _ in range(r.randint(5, 40))), "big" if i % 4 else "small") for i in range(600)]
    rows += [(9000, None, "big"), (9001, "", "big"), (9002, "text", None), (9003, "text", "other")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.5, 3), ("absent", None, 2), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    mix = Mix(docs, targets, shards=4, blocks=50)
    uses = mix.rows().collect()
    by: dict = {}
    for u in uses:
        by.setdefault(u.doc_id, []).append(u.use_no)
    small = {i for i, _, s in rows if s == "small"}
    assert all(sorted(v) == list(range(1, len(v) + 1)) and len(v) <= (3 if k in small else 1) for k, v in by.items())
    assert not {9000, 9001, 9002, 9003} & set(by) and {u.shard for u in uses} == {0, 1, 2, 3}
    report = {x.source: x for x in mix.report().collect()}
    for bucket_docs in (7, 100):
        assert {tuple(u) for u in Mix(docs, targets, shards=4, blocks=50, bucket_docs=bucket_docs).rows().collect()} == {tuple(u) for u in uses}
    assert abs(report["big"].reached_share - 0.5) < 0.01 and abs(report["small"].reached_share - 0.5) < 0.01
    more = Mix(docs, targets, total_tokens=10 * mix.total)
    late = {x.source: x for x in more.report().collect()}
    assert late["small"].most_uses == 3 and late["big"].most_uses == 1 and late["big"].mixed_tokens == late["big"].tokens
    assert Mix(docs.limit(0), targets).rows().count() == 0 and Mix(docs, targets.limit(0)).rows().count() == 0


def test_garbled_text_that_is_common_is_found(spark):
    french = "Le café était fermé, la fenêtre brisée et le garçon très fâché à côté."
    bad = french.encode().decode("latin-1")
    clean = [f"{french} Numéro {i}." for i in range(12)]
    copies = [bad] * 60
    others = [f"{bad} NumÃ©ro {i}." for i in range(60)]
    lost = "список".encode("cp866").decode()  # valid UTF-8 by chance
    russian = [f"Если список пропал, {i}" for i in range(30)] + [f"{lost} {i}" for i in range(3)]
    rows = [(i, t) for i, t in enumerate(clean + copies + others + russian)]
    df = spark.createDataFrame(rows, "file_id long, content string")
    got = {x.id: x.restored for x in mojibake.Garbled(df, most_bits=20).restored().collect()}
    assert set(got) & set(range(162)) == set(range(12, 132))
    assert got[12] == french and got[131] == f"{french} Numéro 59."
