"""PDF files: round trips, what other writers make, and broken files."""

import random
import zlib

import pytest

from nubla.sources.pdf import Reader, pdf_text, text_pdf
from nubla.sources.readers import read_documents
from nubla.sources.sinks import pdf_files


@pytest.mark.parametrize("packed", [False, True])
def test_round_trip(packed):
    rng = random.Random(1)
    for n in (0, 1, 3, 40):
        pages = [["".join(rng.choices("aé ñ€日😀()\\<>/%", k=rng.randint(0, 30))) for _ in range(rng.randint(0, 8))] for _ in range(n)]
        assert pdf_text(text_pdf(pages, packed)) == "".join(" ".join(x for x in p if x) + "\n\n" for p in pages).strip()


def page(content: bytes, fonts: str = "<< /F1 << /Type /Font /Subtype /Type1 /BaseFont /Helvetica >> >>", more: str = "", filters: str = "", wrong: bool = False) -> bytes:
    """A file as an old writer makes it: no compression, a cross-reference table of which nothing is right."""
    length = 3 if wrong else len(content)
    return f"%PDF-1.4\n1 0 obj <</Type/Catalog/Pages 2 0 R>> endobj\n2 0 obj <</Type/Pages/Kids[3 0 R]/Count 1>>endobj\n3 0 obj<</Type/Page/Parent 2 0 R/Contents[4 0 R]/Resources<</Font {fonts} {more}>>>>endobj\n4 0 obj<</Length {length} {filters}>>stream\r\n".encode() + content + b"\nendstream endobj\nxref\n0 1\ntrailer<</Root 1 0 R>>\nstartxref\n0\n%%EOF"


def test_text_operators():
    shown = rb"""BT /F1 12 Tf (One \(two\) \164hree\
!) Tj T* [(W) 80 (ord) -300 (next) -100 (er)] TJ (line) ' 0 0 (quoted) " <e9> Tj % (no comment) Tj
ET BI /W 1 /H 1 ID (x) Tj EI q BT (after) Tj ET Q (caf\351 \2005) Tj"""
    expected = "One (two) three! Word nexter line quoted é after café €5"
    assert pdf_text(page(shown)) == pdf_text(page(shown, wrong=True)) == expected
    assert pdf_text(page(zlib.compress(shown), filters="/Filter/FlateDecode")) == expected
    assert pdf_text(page(shown.hex().encode() + b">", filters="/Filter [/ASCIIHexDecode]")) == expected
    rows = [shown[i : i + 10].ljust(10) for i in range(0, len(shown), 10)]
    up = b"".join(b"\x02" + bytes((a - b) & 255 for a, b in zip(r, before, strict=True)) for r, before in zip(rows, [bytes(10), *rows], strict=False))
    assert pdf_text(page(zlib.compress(up), filters="/Filter/FlateDecode/DecodeParms<</Predictor 12/Columns 10>>")) == expected


def test_fonts_and_forms():
    named = "<< /F1 << /Subtype /Type1 /Encoding << /Differences [65 /eacute /endash 70 /uni00F1] >> >> >>"
    assert pdf_text(page(b"/F1 1 Tf (BFx) Tj", named)) == "–ñx"
    cmap = b"1 begincodespacerange <00> <FF> endcodespacerange 2 beginbfrange <41> <43> <0061> <50> <51> [<00660069> <006C>] endbfrange"
    data = page(b"/F1 1 Tf (ABCPQ) Tj /X Do", "<< /F1 << /Subtype /Type1 /ToUnicode 9 0 R >> >>", "/XObject << /X 10 0 R >>")
    form = b"/F1 1 Tf (CBA) Tj /X Do"
    data += b"\n9 0 obj <</Length %d>> stream\n" % len(cmap) + cmap + b"\nendstream endobj 10 0 obj <</Subtype /Form /Length %d>> stream\n" % len(form) + form + b"\nendstream endobj"
    assert pdf_text(data).startswith("abcfil cba cba")


def test_broken_files(spark, tmp_path):
    """What can't be read is an error of its file; no bytes end a job or never end."""
    good = text_pdf([["hello there"]])
    for data in (b"", b"%PDF-1.7", b"no file", page(b"(x) Tj", filters="/Filter /LZWDecode"), good.replace(b"/Root 1 0 R", b"/Root 1 0 R /Encrypt 5 0 R"), b"%PDF-1.7 1 0 obj " + b"[" * 5000):
        with pytest.raises(ValueError):
            pdf_text(data)
    rng = random.Random(2)
    for packed in (False, True):
        whole = text_pdf([["some text"], ["more"]], packed)
        for _ in range(150):
            cut = bytearray(whole[: rng.randint(0, len(whole))])
            for _ in range(rng.randint(0, 5)):
                if cut:
                    cut[rng.randrange(len(cut))] = rng.randrange(256)
            try:
                assert isinstance(pdf_text(bytes(cut)), str)
            except (ValueError, zlib.error, TypeError, AttributeError):
                pass
    loop = b"%PDF-1.4 1 0 obj <</Type/Catalog/Pages 2 0 R>> endobj 2 0 obj <</Kids [2 0 R 2 0 R]>> endobj"
    assert pdf_text(loop) == "" and Reader(b"(never closed").value() == b"never closed"
    for name, data in (("a.pdf", good), ("b.pdf", b"junk"), ("c.pdf", good[:40]), ("d.txt", "tést".encode())):
        (tmp_path / name).write_bytes(data)
    rows = {r["name"]: (r["text"], r["status"]) for r in read_documents(spark, str(tmp_path)).collect()}
    assert rows == {"a.pdf": ("hello there", "completed"), "b.pdf": (None, "error"), "c.pdf": (None, "error"), "d.txt": ("tést", "completed")}
    made = pdf_files(spark.createDataFrame([(1, "x\ny"), (2, None)], "id int, text string"), "id").collect()
    assert [(r["path"], pdf_text(r["content"]), r["length"] == len(r["content"])) for r in made] == [("1.pdf", "x y", True), ("2.pdf", "", True)]
