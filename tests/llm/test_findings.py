
import base64

import numpy as np

from waymark.llm import html_extract, language_model, media, quality, secrets


def test_quality_counts_every_labelled_row_but_near_copies(spark):
    rng = np.random.default_rng(3)
    word = lambda n: " ".join(f"w{int(x)}" for x in rng.zipf(1.3, n) % 5000)
    rows = [(k, word(120)) for k in range(150)]
    rows += [(150, rows[7][1]), (151, rows[8][1] + " one more"), (152, " ".join(rows[9][1].split()[:60]) + " " + word(60)), (153, None), (154, "two words"), (155, rows[10][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    ids = np.arange(156)
    pools = np.where(ids == 155, 1, 0).astype(np.int8)  # the copy of row 10 is in another pool
    assert sorted(quality.left_out(docs, ids, pools).tolist()) == [150, 151]
    assert quality.left_out(docs.where("false"), ids, pools).tolist() == []


def test_secrets_keys_of_any_length_alphabet_and_layout():
    p256 = bytes.fromhex("30770201010420") + bytes(range(200, 232)) + bytes.fromhex("a00a06082a8648ce3d030107a144034200") + bytes([4]) + bytes(range(190, 254))
    k1 = bytes.fromhex("30740201010420") + bytes(range(32)) + bytes.fromhex("a00706052b8104000aa144034200") + bytes([4]) + bytes(range(64))
    field = lambda x: len(x).to_bytes(4, "big") + x
    ssh = b"openssh-key-v1\0" + field(b"none") + field(b"none") + field(b"") + (1).to_bytes(4, "big") + field(b"p" * 51) + field(b"q" * 136)
    found = lambda text: [(text[a:b], kind) for a, b, kind in secrets.confirmed_spans(text)]
    wrapped = lambda x, gap: gap.join(x[k : k + 64] for k in range(0, len(x), 64))
    for key, kind in ((p256, "der"), (k1, "der"), (ssh, "ssh")):
        plain, url = base64.b64encode(key).decode(), base64.urlsafe_b64encode(key).decode()
        for shown in (plain, url, url.rstrip("="), wrapped(plain, "\n"), wrapped(plain, "\r\n    "), wrapped(plain, "\\n")):
            for text in (f"key={shown}", f"é {shown}\nMore words\nfollow", f"BEGIN\\n{shown}\\nend", f"{shown}"):
                assert found(text) == [(shown, kind)], (shown, text)
    assert "-" in base64.urlsafe_b64encode(p256).decode() or "_" in base64.urlsafe_b64encode(p256).decode()
    for shown in (p256.hex(), p256.hex().upper(), k1.hex().upper()):
        assert found(f"k: {shown} end") == [(shown, "hexder")]
    body = wrapped(base64.b64encode(bytes(range(96))).decode(), "\n")
    head = "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,00112233445566778899AABBCCDDEEFF\n\n"
    pem = f"-----BEGIN RSA PRIVATE KEY-----\n{head}{body}\n-----END RSA PRIVATE KEY-----"
    assert found(f"a {pem} b") == [(pem, "pem")] and secrets.masked(f"a {pem} b") == "a [pem] b"
    noted = f"-----BEGIN EC PRIVATE KEY-----\nComment: x-y\n\n{base64.b64encode(k1).decode()}\n-----END EC PRIVATE KEY-----"
    assert found(noted) == [(noted, "pem")]
    # Structure still decides: wrong lengths, a cut-off key, ciphertext of no whole blocks, plain words, a certificate's inner key.
    broken = p256[:3] + b"\x02" + p256[4:]
    for text in (base64.b64encode(broken).decode(), base64.b64encode(p256[:-3]).decode(), pem.replace(body, body[:-4]), "MAIN MEMORY\nMODEL\nMAP " * 20, broken.hex().upper()):
        assert found(text) == [], text
    spki = bytes.fromhex("302a300506032b6570032100") + bytes(32)
    inner = bytes.fromhex("a0030201020201010400") + bytes(3) * 0 + spki
    certificate = b"\x30" + bytes([2 + len(inner)]) + b"\x30" + bytes([len(inner)]) + inner
    assert found(wrapped(base64.b64encode(certificate).decode(), "\n")) == []


def extracted(spark, pages):
    df = spark.createDataFrame([(k, f"http://h/{k}", page) for k, page in enumerate(pages)], "page_id long, url string, html string").repartition(3)
    return {r.page_id: r.text for r in html_extract.extract(df).collect()}


def test_html_wrapper_decides_inside_an_article_too(spark):
    page = lambda k: f"<html><body><article><h1>T{k}</h1><p>Text {k} <i>of</i> its own</p><p>{'Twice' if k < 2 else f'Once {k}'}</p><div><p>Read <b>more</b> here</p></div></article></body></html>"
    got = extracted(spark, [page(k) for k in range(12)])
    assert got[0] == "T0\nText 0 of its own\nTwice" and got[5] == "T5\nText 5 of its own\nOnce 5"
    # Copies of one article are no template; nor are repeated rows, or what two pages happen to share.
    same = [f"<article><p>{'long text ' * 20}</p><p>{k}</p></article>" for k in range(8)]
    assert extracted(spark, same)[3].startswith("long text") and extracted(spark, [page(0)] * 9)[0].endswith("Read more here")


def test_html_template_has_all_siblings_inline_text_and_layouts(spark):
    def page(k):
        menu = "".join(f"<li><a href='/{x}'>{x}</a></li>" for x in ("Home", "News", "About"))
        notes = "<p>Note <b>one</b></p><p>Note two</p><p>Note three</p>"
        if k % 2:
            return f"<html><body><div class='x'><ul>{menu}</ul></div><div class='body'><p>Text {k}</p><p>More {k}</p></div><div class='z'>{notes}</div></body></html>"
        return f"<html><body><table><tr><td><ul>{menu}</ul></td><td><h2>Text {k}</h2><p>More {k}</p></td></tr></table><section>{notes}</section></body></html>"

    got = extracted(spark, [page(k) for k in range(30)])
    assert all(got[k] == f"Text {k}\nMore {k}" for k in range(30))
    four = [page(k) for k in (1, 3, 5, 7)]  # alignment alone
    template = frozenset((a.removeprefix("/#root"), b) for a, b in html_extract.induce(four))
    assert html_extract.main_text(four[0], template) == "Text 1\nMore 1"


def test_language_model_counts_go_beyond_32_bits(spark):
    sizes = [2 * language_model.CLASSES, 2 << language_model.SLOT_BITS]
    tables = [np.zeros(n, np.int64) for n in sizes]
    tables[0][3], tables[1][70_000] = 2**31 - 5, 2**33
    made = spark.createDataFrame(language_model.packed(tables)).unionByName(spark.createDataFrame(language_model.packed(tables)))
    got = language_model.merged(made.selectExpr("int(part) AS part", "int(segment) AS segment", "blob"), sizes)
    assert got[0][3] == 2**32 - 10 and got[1][70_000] == 2**34 and sum(int(t.sum()) for t in got) == 2**32 - 10 + 2**34


def test_media_columns_hold_all_tracks_and_key_ranges(spark):
    one = media.encode(bytes(k % 251 for k in range(64 * 50)))
    at = one.index(b"trak") - 4
    track = one[at : at + int.from_bytes(one[at : at + 4], "big")]
    moov = one.index(b"moov") - 4
    size = int.from_bytes(one[moov : moov + 4], "big")
    two = one[:moov] + (size + len(track)).to_bytes(4, "big") + one[moov + 4 : moov + size] + track + one[moov + size :]
    rows = spark.createDataFrame([(1, bytearray(one)), (2, bytearray(two)), (3, bytearray(b"")), (4, None)], "doc_id long, media binary")
    got = {r.doc_id: r for r in media.media_features(rows).collect()}
    assert [len(got[k].tracks) for k in (1, 2, 3, 4)] == [1, 2, 0, 0] and got[4].feature is None
    for k, m in ((1, one), (2, two)):
        for told, t in zip(got[k].tracks, media.describe(m)):
            assert (told.codec, told.samples, told.key_starts) == ("ipcm", 50, t["starts"][t["keys"]].tolist()) and len(told.key_ends) == 4
            assert told.seconds == t["duration"] / t["scale"] and told.key_ends == t["ends"][t["keys"]].tolist()
