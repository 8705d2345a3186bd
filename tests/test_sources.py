import io
import wave
import zipfile

import pytest
from pyspark.sql import functions as F

from lorewright.config import CharacterConfig, SpeechConfig
from lorewright.operators import audio, pages
from lorewright.sources import readers


def epub(bodies, spine=None, extra=()):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("mimetype", "application/epub+zip")
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="OEBPS/p.opf"/></rootfiles></container>')
        items = "".join(f'<item id="c{i}" href="c{i}.xhtml" media-type="application/xhtml+xml"/>' for i in range(len(bodies)))
        refs = "".join(f'<itemref idref="c{i}"/>' for i in spine or range(len(bodies)))
        z.writestr("OEBPS/p.opf", f'<package xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title>Libro</dc:title></metadata><manifest>{items}</manifest><spine>{refs}</spine></package>')
        for i, b in enumerate(bodies):
            z.writestr(f"OEBPS/c{i}.xhtml", f"<html><head><title>t</title></head><body>{b}</body></html>")
        for name, data in extra:
            z.writestr(name, data)
    return out.getvalue()


def test_epub_order_and_split():
    meta, sections = readers.epub_sections(epub(["<h1>Dos</h1><p>b</p>", "<h1>Uno</h1><p>a</p><h1>Más</h1><p>c</p>"], spine=[1, 0]))
    assert meta["title"] == "Libro" and [s["title"] for s in sections] == ["Uno", "Más", "Dos"] and sections[2]["text"] == "Dos\n\nb"


@pytest.mark.parametrize("extra", [[("../x", "1")], [("META-INF/encryption.xml", "1")], [("big", "0" * 9_000_000)]])
def test_epub_refused(extra):
    with pytest.raises(ValueError):
        readers.epub_sections(epub(["<p>a</p>"], extra=extra))


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("Hola\r\nmundo", encoding="utf-8")
    (tmp_path / "b.txt").write_bytes(b"\xff\xfe\x00")
    (tmp_path / "c.epub").write_bytes(epub(["<h1>Uno</h1><p>a</p>"]))
    (tmp_path / "d.epub").write_bytes(b"PK\x03\x04broken")
    (tmp_path / "e.exe").write_bytes(b"x")
    f = readers.files(spark, str(tmp_path))
    name = lambda r: r["path"].rsplit("/", 1)[1]
    assert {name(r): r["text"] for r in readers.read_text(f).collect()} == {"a.txt": "Hola\nmundo", "b.txt": None}
    assert {name(r) for r in readers.problems(f).collect()} == {"b.txt", "e.exe"}
    packed = {name(r): (r["section_title"], r["problem"] is None) for r in readers.read_packed(f).collect()}
    assert packed == {"c.epub": ("Uno", True), "d.epub": (None, False)}


def test_docx():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Uno</w:t></w:r></w:p><w:p><w:r><w:rPr><w:i/></w:rPr><w:t>hola</w:t></w:r></w:p></w:body></w:document>')
        z.writestr("word/styles.xml", f'<w:styles {w}><w:style w:styleId="Heading1"><w:name w:val="heading 1"/></w:style></w:styles>')
    title, blocks = readers.docx_blocks(out.getvalue())
    assert title is None and [(b["text"], b["heading_level"], b["emphasis"]) for b in blocks] == [("Uno", 1, []), ("hola", None, ["italic"])]


def test_html_blocks():
    blocks, removed = pages.html_blocks('<body><nav>x</nav><h2>T</h2><p>uno<br>dos <b>tres</b></p><hr><div style="display: none">no</div>suelto<script>a</script></body>')
    assert [(b["text"], b["heading_level"]) for b in blocks] == [("T", 2), ("uno\ndos tres", None), ("***", None), ("suelto", None)] and removed == 3
    assert blocks[1]["emphasis"] == ["bold"] and blocks[2]["scene_break"] and pages.html_blocks("") == ([], 0)


def test_reflow_and_edges(spark):
    assert pages.reflow("Era una no-\nche fría\ny larga.\nOtra frase\n\n***\n—Hola\nC a p í t u l o  1") == "Era una noche fría y larga.\n\nOtra frase\n\n***\n\n—Hola\n\nCapítulo 1"
    df = spark.createDataFrame([(1, 1, "HEADER\nuno\nHEADER\ndos\n1"), (1, 2, "HEADER\ntres\n2"), (1, 3, None), (1, 4, "")], "b int, p int, text string")
    got = [r["line"] for r in pages.clean_edges(df, "b", "p").orderBy("p", "line_no").collect()]
    assert got == ["uno", "HEADER", "dos", "tres", ""]


def test_sound(spark):
    pcm = audio.resample(b"\x00\x00\x10\x00\x20\x00\x30\x00", 1, 4, 2)
    assert pcm == b"\x00\x00\x20\x00"
    with wave.open(io.BytesIO(audio.assemble([(b"\0\0" * 80, 8000, 0), (b"\0\0" * 160, 16000, 500)], trailing_ms=100)), "rb") as w:
        assert (w.getframerate(), w.getnframes()) == (8000, 80 + 4000 + 80 + 800)
    with pytest.raises(ValueError):
        audio.assemble([])
    assert audio.silent_speech(spark.createDataFrame([(1, "hola")], "i int, t string"), ["i"], "t").select(F.octet_length("pcm")).first()[0] == 160


def test_voice_models(spark, tmp_path):
    (tmp_path / "m.onnx.json").write_text('{"language":{"code":"es"},"speaker_id_map":{"a":0,"b":1}}')
    (tmp_path / "n.onnx.json").write_text('{"language":{"code":"en"},"speaker_id_map":{}}')
    assert {r["voice_id"] for r in readers.read_voice_models(spark, str(tmp_path)).collect()} == {"m::a", "m::b", "n"}


def test_config():
    for bad in (lambda: CharacterConfig(accept=0.5), lambda: CharacterConfig(candidates=13), lambda: SpeechConfig(chunk_chars=10), lambda: SpeechConfig(segment_ms=-1)):
        with pytest.raises(ValueError):
            bad()
