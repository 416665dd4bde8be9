"""Cases worked out by hand."""

from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewright.functions import text as T
from pagewright.functions import values as V
from pagewright.operators import exam, images
from pagewright.operators.layout import indent_of, join_words
from pagewright.sources import files, io

CASES = [
    (T.split_radio_prefix, {"Oo": "○ o", "Or": "○ r", "O .csv": "○ .csv", "0txt": "○ txt", "Otro": "Otro", "Orden": "Orden", "O": "O", "O5": "O5", "○ x": "○ x", "O.csv": "○ .csv", "0.5": "○ .5", "OK todo": "○ K todo", "oeste": "○ este", "Ordenes": "○ rdenes", "O rden": "O rden", "o rden": "○ rden", "  © texto ": "  ○ texto", "": ""}),
    (T.split_underscores, {"____esun": "____ esun"}),
    (T.fix_checked, {"[x] si": "☑ si"}),
    (T.collapse_spaces, {"  a    b  c": "  a b  c"}),
    (T.split_glued_words, {"esun": "es un", "dela delante": "de la delante"}),
    (T.fix_digit_letters, {"1l0": "110", "1O0": "100"}),
    (T.shorten_runs, {"." * 12: "...", "-" * 12: "─" * 10, "_" * 12: "_" * 10}),
    (T.drop_noise_lines, {"ab\n||\n○\na)\n": "ab\n"}),
    (T.clean_option_text, {"○ a) Hola": "Hola", "O .csv": ".csv", "Otro": "Otro", "- x": "x", "a.b": "b", "0.5": ".5", "a.append(x)": "append(x)"}),
    (T.parse_languages, {"spa, eng": "spa+eng", "": "spa"}),
    (T.fix_inverted_bang, {"str(¡+1)": "str(j+1)", "=¡+1": "=j+1", "(¡)": "(j)", "¡hola": "¡hola"}),
]


@pytest.mark.parametrize("function, cases", CASES, ids=[f.__name__ for f, _ in CASES])
def test_text(spark, function, cases):
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "a string, b string")
    assert {r.a: r.got for r in df.select("a", function(F.col("a")).alias("got")).collect()} == cases
    assert df.select(function(F.lit(None).cast("string")).alias("g")).first().g in (None, "spa")


def test_exam_text(spark):
    text = "\n".join(["Examen", "Pregunta 1", "Cual es la salida:", "x = 1", "print(x)", "uno", "dos", "Pregunta 2", "Elige.", "a) si", "b) no"])
    rule = "─" * 50
    want = "\n".join(["Examen", "", rule, "", "Pregunta 1", "Cual es la salida:", "", "x = 1", "print(x)", "", "○ uno", "○ dos", "", rule, "", "Pregunta 2", "Elige.", "○ si", "○ no"])
    df = spark.createDataFrame([(1, text), (2, "nada que ver"), (3, "a) x\nb) y\nc) z\nd) w"), (4, "")], "image_id long, text string")
    got = {r.image_id: (r.route, r.text) for r in exam.post_process_documents(df).collect()}
    assert got == {1: ("exam", want), 2: ("plain", "nada que ver"), 3: ("options", "○ x\n○ y\n○ z\n○ w"), 4: ("plain", "")}


def test_hidden_options(spark):
    lines = ["Pregunta 1", "Elige:", "x = 1", "y = 2", "print(x)", "print(y)", "", "Pregunta 2", "", "Sin mas"]
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate(lines)], "image_id long, line_no int, line string")
    got = [(r.header, r.statement, r.code, r.options) for r in exam.extract_questions(df).orderBy("q_no").collect()]
    assert got == [("Pregunta 1", ["Elige:"], ["x = 1"], ["y = 2", "print(x)", "print(y)"]), ("Pregunta 2", ["Sin mas"], [], [])]


def test_scale_and_indent(spark):
    df = spark.createDataFrame([(1, 1080, 1920)], "image_id long, height int, width int")
    r = images.upscale_plan(df).first()
    assert abs(r.scale - 2.037) < 1e-3 and abs(r.new_height - 2200) <= 1 and abs(r.new_width - 3911) <= 1
    px = spark.createDataFrame([(14,), (15,), (400,)], "px int")
    assert [r.i for r in px.select(indent_of(F.col("px"), F.lit(1000)).alias("i")).collect()] == [0, 1, 20]


def test_wide_gaps(spark):
    words = [(0, "a", 10), (20, "b", 10), (40, "c", 10), (90, "d", 10)]
    df = spark.createDataFrame([(words,)], "w array<struct<left:int,text:string,width:int>>")
    assert df.select(join_words(F.col("w")).alias("t")).first().t == "a b c   d"


def test_pixels(spark):
    image = lambda h, w, c, data: (h, w, c, bytearray(data))
    rows = [(1, image(2, 2, 3, [255, 0, 0] * 4)), (2, image(1, 1, 1, [7])), (3, image(400, 500, 1, [9] * 200_000))]
    df = spark.createDataFrame(rows, "image_id long, image struct<height:int,width:int,nChannels:int,data:binary>")
    got = {r.image_id: r for r in images.pixel_features(df).collect()}
    assert got[1].hist[29] == 90_000 and got[2].hist[7] == 90_000 and got[3].hist[9] == 90_000 and got[3].layout_hist[9] == 200_000
    assert all(r.laplacian_var == 0 for r in got.values())


def test_reductions_equal_areas_and_interpolation():
    """Means of covered cells, by spelling out each share; growing by interpolation; images of one shape together."""
    rng = np.random.default_rng(4)
    for old, new in ((720, 300), (601, 600), (7, 3), (10, 10), (5, 1), (1, 1)):
        x = rng.integers(0, 256, (2, old, 3)).astype(float)
        share = np.clip(np.minimum((np.arange(new) + 1)[:, None] * old / new, np.arange(old) + 1) - np.maximum(np.arange(new)[:, None] * old / new, np.arange(old)), 0, None) * new / old
        assert np.allclose(images.reduced(x, new), np.einsum("nk,iko->ino", share, x))
    assert np.allclose(images.grown(np.array([[[0.0], [10.0]]]), 4)[0, :, 0], [0, 2.5, 7.5, 10]) and np.allclose(images.grown(np.full((1, 1, 2), 7.0), 3), 7)
    many = rng.integers(0, 256, (3, 640, 90)).astype(np.uint8)
    assert all((images.resized(many, 300, 300)[k] == images.resized(many[k : k + 1], 300, 300)[0]).all() for k in range(3))


def test_export_and_words_round_trip(spark, tmp_path):
    from pagewright import fixtures
    from pagewright.plans.workflows import lay_out

    words = fixtures.ocr_words(spark, "/root/testdata/sf0.001").where("image_id < 3").where("text != ''")
    io.write_ocr_words(words.select(*[c.split()[0] for c in io.WORD_SCHEMA.split(", ")]), str(tmp_path / "w"))
    back = io.read_ocr_words(spark, str(tmp_path / "w"))
    assert back.count() == words.count() and back.drop("file").exceptAll(words.select(*back.drop("file").columns)).count() == 0
    p = lay_out(back, 8.0)
    assert len(io.export(p.docs, p.placed, " ALL ", str(tmp_path / "out"))) == 3
    tree = spark.read.json(str(tmp_path / "out/json")).collect()
    assert {(r.image_id, r.name) for r in tree} == {(i, f"{i}_1970-01-01_00-00-00.json") for i in range(3)}
    content = {r.image_id: r.content for r in io.txt_content(p.docs).collect()}
    txt = spark.read.parquet(str(tmp_path / "out/txt")).collect()
    assert {r.image_id: r.content for r in txt} == {i: "\ufeff" + c for i, c in content.items()} and {r.name for r in txt} == {f"{i}_1970-01-01_00-00-00.txt" for i in range(3)}
    docx = {r.image_id: r.content for r in spark.read.parquet(str(tmp_path / "out/docx")).collect()}
    assert all(docx[i].startswith("Texto Extraído por OCR\nIdioma: spa\n") for i in range(3)) and len(docx) == 3
    when = datetime(2026, 3, 1, 14, 30, 25)
    io.write_txt(p.docs.withColumn("path", F.concat(F.lit("/in/scan"), "image_id", F.lit(".png"))), str(tmp_path / "each"), when, one_file_each=True)
    each = {f.name: f.read_bytes() for f in (tmp_path / "each").iterdir() if not f.name.startswith((".", "_"))}
    assert each == {f"scan{i}_2026-03-01_14-30-25.txt": ("\ufeff" + c).encode() for i, c in content.items()} and (tmp_path / "each/_SUCCESS").read_text() == "3"
    with pytest.raises(ValueError):
        io.validate_format("pdf")


def test_images_are_read_and_rejected(spark, tmp_path):
    import struct
    import zlib

    def png(w, h):
        chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
        return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress((b"\0" + b"\xff\0\0" * w) * h)) + chunk(b"IEND", b"")

    (tmp_path / "a.PNG").write_bytes(png(4, 3))
    (tmp_path / "b.gif").write_bytes(b"no")
    (tmp_path / "c.webp").write_bytes(b"no")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "d.png").write_bytes(b"")
    good, bad = io.read_images(spark, str(tmp_path))
    assert [r.image.width for r in good.collect()] == [4]
    assert sorted((r.path[-5:], r.bytes, r.reason) for r in bad.collect()) == [(".webp", 2, "broken"), ("b.gif", 2, "suffix"), ("d.png", 0, "empty")]


def test_word_rows_good_and_bad(spark, tmp_path):
    names = [c.split()[0] for c in io.WORD_SCHEMA.split(", ")]
    row = ["7", "0", "3", "spa", "100", "50", "1", "hola", "91.5", "1", "2", "3", "4", "0", "1", "0", "0"]
    put = lambda **other: "\t".join(other.get(n, v) for n, v in zip(names, row, strict=True))
    bad = [put(conf="x"), put(image_id=""), put(conf=""), "only\ttwo", put() + "\tmore", put(left="1.5")]
    (tmp_path / "page12.tsv").write_text("\n".join(["\t".join(names), put(), bad[0], put(text=""), *bad[1:], put(text='say "no"')]) + "\n")
    good, lost = io.split_ocr_words(spark, str(tmp_path))
    assert [(r.image_id, r.text, r.conf, r.left, io_page) for r, io_page in ((r, r.p) for r in good.withColumn("p", io.page_of_file(F.col("file"))).collect())] == [(7, t, 91.5, 1, 12) for t in ("hola", "", 'say "no"')]
    got = [(r.line, r.reason) for r in lost.collect()]
    assert [r for _, r in got] == ["malformed", "missing image_id", "missing conf", "malformed", "malformed", "malformed"]
    assert [x for x, r in got if r == "malformed"] == [bad[0], *bad[3:]]
    assert io.read_ocr_words(spark, str(tmp_path)).count() == 3


def test_odd_words_come_back_from_files(spark, tmp_path):
    texts = ["a ", " a", " ", "\\N", '"', '""', '"a', "a\\", "#", "\u2028", "\ufeff", "", "\x0b", "\x85", "\xa0x\xa0", "a"]
    words = spark.createDataFrame([(7, 0, 3, "spa", 1, 1, i, t, 50.0, 1, 1, 1, 1, 0, 1, 0, i) for i, t in enumerate(texts)], io.WORD_SCHEMA)
    io.write_ocr_words(words, str(tmp_path / "w"))
    good, lost = io.split_ocr_words(spark, str(tmp_path / "w"))
    assert [r.text for r in good.orderBy("ord").collect()] == texts and lost.count() == 0
    assert all(p.name.endswith(".gz") for p in (tmp_path / "w").iterdir() if p.name.startswith("part-"))


def test_names_and_files(spark, tmp_path):
    """Equal stems get their pages' ids; files written again leave no doubles; a failed job takes its files back."""
    df = spark.createDataFrame([(1, "/a/x.png"), (2, "/b/x.jpg"), (3, "/b/y.v2.png"), (9, "/c/x.png")], "image_id long, path string")
    out = io.named(df, datetime(2026, 3, 1, 14, 30, 25), "txt").withColumn("content", F.concat(F.lit("é"), "image_id"))
    for _ in range(2):
        files.write_files(out.repartition(3), str(tmp_path / "f"))
        got = {r.name: bytes(r.content).decode() for r in files.read_files(spark, str(tmp_path / "f")).collect()}
        assert got == {"x_2026-03-01_14-30-25.txt": "é1", "x_2026-03-01_14-30-25_2.txt": "é2", "y.v2_2026-03-01_14-30-25.txt": "é3", "x_2026-03-01_14-30-25_9.txt": "é9"}
        assert sorted(p.name for p in (tmp_path / "f").iterdir()) == sorted([*got, "_SUCCESS"])
    failing = out.repartition(1).sortWithinPartitions("image_id").withColumn("content", F.when(F.col("image_id") < 9, F.col("content")).otherwise(F.raise_error(F.lit("no"))))
    with pytest.raises(Exception, match="no"):
        files.write_files(failing, str(tmp_path / "g"))
    assert not (tmp_path / "g").exists() or not [p for p in (tmp_path / "g").iterdir()]


def test_a_task_without_rows_leaves_no_folder(tmp_path):
    def failing():
        raise ValueError("no")
        yield

    writer = files.NamedFilesWriter(str(tmp_path / "f"))
    with pytest.raises(ValueError, match="no"):
        writer.write(failing())
    assert writer.write(iter([])).files == 0 and not (tmp_path / "f").exists()


def test_one_decimal(spark):
    values = [k / 20 for k in range(0, 2001)] + [k / 140 for k in range(0, 14001, 7)] + [0.25, 0.35, 0.15, 53.25, 1e-9, 99.95]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert [r.t for r in df.select(T.one_decimal(F.col("x")).alias("t")).collect()] == [f"{v:.1f}" for v in values]


def test_code_lines(spark):
    """One literal line for each pattern and operator, and lines of prose that match none."""
    code = [
        "if x", "elif y", "return 3", "from here on", "x = 1", "total_2 =3", "f(1)", "do print (x)", "y: input(", "# note", "for i in range (3)", "n len(x)", "n int(x)", "n str(x)", "n float(x)", "n list(x)", "n dict(x)",
        "es True", "es None", "x[1] = 2", "class {", "}", "a;", "public static x", "int n", "n System.out", "Console.Read", "n cout << a", "n cin >> a", "n printf (", "n scanf(", "a == b", "a >= b", "a <= b", "a != b", "a += b", "a -= b", "a *= b", "a /= b", "a %= b",
        "a => b", "a -> b",
    ]
    prose = ["Elige la correcta", "uno", "El valor", "Printing", "Truey", "size int", "(a)", "iffy", "¿Cual es?", ""]
    df = spark.createDataFrame([(t,) for t in code + prose], "s string").select("s", T.is_code_line(F.col("s")).alias("c"))
    assert [r.s for r in df.collect() if r.c] == code


def test_words_with_circle_signs(spark):
    assert set(V.AFTER_BIG_O) == set("bcfhijklmnopqstuvwxyz") - {"o"} and set(V.AFTER_SMALL_O) - set(V.AFTER_BIG_O) == {"d"}
    assert len(V.SAFE_STEMS) == 13 and V.SAFE_STEMS[0] == "rden"


def plain_resize(gray, height, width):
    """Cell by cell: mean of what a new cell covers when shrinking, linear between cell centres when growing."""

    def axis(old, new):
        out = []
        for k in range(new):
            if new <= old:
                lo, hi = k * old / new, (k + 1) * old / new
                w = {i: max(0.0, min(hi, i + 1) - max(lo, i)) / (hi - lo) for i in range(int(lo), min(old, int(np.ceil(hi))))}
            else:
                at = min(max((k + 0.5) * old / new - 0.5, 0), old - 1)
                low = min(int(at), max(old - 2, 0))
                w = {low: 1 - (at - low)}
                w[min(low + 1, old - 1)] = w.get(min(low + 1, old - 1), 0) + at - low
            out.append(w)
        return out

    rows, cols = axis(gray.shape[0], height), axis(gray.shape[1], width)
    return np.array([[sum(a * b * float(gray[i, j]) for i, a in r.items() for j, b in c.items()) for c in cols] for r in rows])


@pytest.mark.parametrize("shape", [(7, 5), (40, 13), (4, 40), (17, 29), (1, 9)])
def test_resizing_of_pictures(shape):
    gray = np.random.default_rng(sum(shape)).integers(0, 256, shape).astype(np.uint8)
    assert np.abs(images.resized(gray, 12, 15).astype(float) - plain_resize(gray, 12, 15)).max() <= 0.5 + 1e-9


def test_colours_to_gray():
    bgr = np.random.default_rng(3).integers(0, 256, (6, 9, 3)).astype(np.uint8)
    got = images.gray_of(bgr.tobytes(), 6, 9, 3).astype(float)
    assert np.abs(got - (0.114 * bgr[:, :, 0] + 0.587 * bgr[:, :, 1] + 0.299 * bgr[:, :, 2])).max() <= 0.51


def test_strip_takes_all_white_space(spark):
    texts = ["", " ", " a ", "  a b　\n", "\x85x\x0b", "​z", "é \t", "\x1fq", "a"]
    df = spark.createDataFrame([(t,) for t in texts], "s string").select(T.strip(F.col("s")).alias("a"), F.regexp_replace("s", r"(?U)^\s+|\s+$", "").alias("b"))
    assert all(r.a == r.b for r in df.collect())
