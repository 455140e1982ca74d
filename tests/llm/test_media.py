import hashlib
import struct
import zlib

import numpy as np
import pytest

from weftlink.llm.media import area_resize, decode_bmp, decode_image, decode_netpbm, difference_hash, encode_pgm, from_npy, image_tiles, text_media, to_npy


def bmp(rgb, bits=24, top_down=False, palette=None):
    height, width = rgb.shape[:2]
    rows = []
    for line in rgb if top_down else rgb[::-1]:
        if bits == 24:
            raw = line[:, ::-1].astype(np.uint8).tobytes()
        elif bits == 32:
            raw = np.concatenate([line[:, ::-1], np.zeros((width, 1))], axis=1).astype(np.uint8).tobytes()
        elif bits == 8:
            raw = line.astype(np.uint8).tobytes()
        elif bits == 4:
            even = np.append(line, [0] * (width % 2))
            raw = (even[::2] << 4 | even[1::2]).astype(np.uint8).tobytes()
        else:
            raw = np.packbits(line).tobytes()
        rows.append(raw + bytes(-len(raw) % 4))
    table = b"" if palette is None else b"".join(bytes([*p[::-1], 0]) for p in palette)
    offset = 54 + len(table)
    head = b"BM" + struct.pack("<IHHI", offset + sum(map(len, rows)), 0, 0, offset)
    return head + struct.pack("<IiiHHIIiiII", 40, width, -height if top_down else height, 1, bits, 0, 0, 0, 0, 0 if palette is None else len(palette), 0) + table + b"".join(rows)


RGB = np.random.default_rng(1).integers(0, 256, (5, 7, 3))


@pytest.mark.parametrize("bits", [24, 32])
@pytest.mark.parametrize("down", [True, False])
def test_bmp_colours(bits, down):
    assert (decode_bmp(bmp(RGB, bits, down)) == RGB).all()


@pytest.mark.parametrize("bits", [1, 4, 8])
def test_bmp_palettes(bits):
    palette = np.random.default_rng(2).integers(0, 256, (2**bits, 3)).tolist()
    index = np.random.default_rng(3).integers(0, 2**bits, (5, 7))
    assert (decode_bmp(bmp(index, bits, palette=palette)) == np.array(palette)[index]).all()


def test_netpbm_kinds():
    grey = RGB[..., 0]
    text = lambda a: " ".join(map(str, a.ravel())).encode()
    assert (decode_netpbm(b"P2 # c\n7 5\n255\n" + text(grey)) == grey).all()
    assert (decode_netpbm(b"P3\n7 5 255\n" + text(RGB)) == RGB).all()
    assert (decode_netpbm(b"P5\n# c\n7 5\n255\n" + grey.astype(np.uint8).tobytes()) == grey).all()
    assert (decode_netpbm(b"P6 7 5 255\n" + RGB.astype(np.uint8).tobytes()) == RGB).all()
    assert (decode_netpbm(b"P5 7 5 65535\n" + (grey * 257).astype(">u2").tobytes()) == grey * 257).all()
    ink = grey > 128
    want = np.where(ink, 0, 255)
    assert (decode_netpbm(b"P1\n7 5\n" + text(ink.astype(int))) == want).all()
    assert (decode_netpbm(b"P4\n7 5\n" + np.packbits(ink, axis=1).tobytes()) == want).all()
    # samples that look like white space are samples
    odd = np.full((2, 3), 32, np.uint8)
    assert (decode_image(encode_pgm(odd)) == odd).all()


@pytest.mark.parametrize("data", [b"", b"P5", b"P5 9 9 255\nxx", b"BM", b"GIF89a", b"P2 3 3 255\n1 2"])
def test_broken(data):
    with pytest.raises(ValueError):
        decode_image(data)


def test_area_resize_is_the_mean():
    image = np.random.default_rng(5).integers(0, 256, (12, 18)).astype(np.uint8)
    assert np.allclose(area_resize(image, 4, 6), image.reshape(4, 3, 6, 3).mean(axis=(1, 3)))
    fine = np.repeat(np.repeat(image, 5, axis=0), 7, axis=1)  # 60 x 126, to 5 x 9 by whole numbers
    assert np.allclose(area_resize(image, 5, 7), fine.reshape(5, 12, 7, 18).mean(axis=(1, 3)))
    assert np.isclose(area_resize(image, 7, 5).mean(), image.mean())


def test_hash_tells_gradients():
    up = np.tile(np.arange(64), (64, 1)).astype(np.uint8)
    assert difference_hash(up) == "f" * 16 and difference_hash(up[:, ::-1]) == "0" * 16


def test_tiles(spark):
    rows = [(1, encode_pgm(np.arange(64 * 64).reshape(64, 64) % 256), "t"), (2, b"no image", "t"), (3, None, "t"), (4, bmp(RGB), "t")]
    out = {r["id"]: r for r in image_tiles(spark.createDataFrame(rows, "id long, image binary, tile string"), tile=(16, 8)).collect()}
    assert from_npy(out[1]["tile"]).shape == (16, 8) and from_npy(out[4]["tile"]).shape == (16, 8, 3)
    assert out[2]["tile"] is None and out[2]["problem"] and out[3]["dhash"] is None


def test_tiles_leave_the_images_as_they_are(spark):
    images = spark.createDataFrame([(1, encode_pgm(np.zeros((2, 2))), "z")], "`meta.k` long, image binary, tile string")
    before = list(images.schema.names)
    for _ in range(2):  # the same table serves twice
        out = image_tiles(images, tile=(1, 1))
        assert out.columns == ["meta.k", "image", "tile", "dhash", "problem"] and out.count() == 1
        assert images.schema.names == images.columns == before


def test_texts(docs, rows, empty):
    out = text_media(docs).collect()
    assert len(out) == len(rows)
    by = {}
    for r in out:
        by.setdefault(r["payload_sha256"], set()).add((r["media_sha256"], r["feature"], r["media_bytes"], r["tail_crc32"]))
    assert all(len(v) == 1 for v in by.values())
    want = []
    for r in rows:
        data = (r[1] or "").encode()
        padded = data + bytes(-len(data) % 64 or (64 if not data else 0))
        media = to_npy(np.frombuffer(padded, np.uint8).reshape(-1, 64))
        want.append((str(r[0]), len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]), len(media), hashlib.sha256(media).hexdigest()))
    assert sorted(want) == sorted((str(r["doc_id"]), r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"], r["media_bytes"], r["media_sha256"]) for r in out)
    assert text_media(empty).count() == 0


def test_bands_do_not_matter():
    image = np.random.default_rng(4).integers(0, 256, (333, 64)).astype(np.uint8)
    whole = area_resize(image, 8, 9)
    assert all(np.allclose(area_resize(image, 8, 9, band), whole) for band in (1, 64, 130, 64 * 50)) and np.isclose(whole.mean(), image.mean())


def test_hash_of_a_long_text_is_bounded():
    import tracemalloc

    image = np.zeros((1 << 19, 64), dtype=np.uint8)  # 32 MB
    tracemalloc.start()
    difference_hash(image)
    assert tracemalloc.get_traced_memory()[1] < 64 << 20
