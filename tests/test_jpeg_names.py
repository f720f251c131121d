"""Real JPEG files: mixed-case suffixes, blanks and signs in names, damaged and finished files."""

import numpy as np
import pytest

from reportlake.operators.images import prepare_folder


def write_jpeg(spark, path, pixels):
    """By the JVM's own encoder."""
    jvm = spark._jvm
    image = jvm.java.awt.image.BufferedImage(pixels.shape[1], pixels.shape[0], jvm.java.awt.image.BufferedImage.TYPE_BYTE_GRAY)
    for (y, x), v in np.ndenumerate(pixels):
        image.getRaster().setSample(x, y, 0, int(v))
    assert jvm.javax.imageio.ImageIO.write(image, "jpg", jvm.java.io.File(str(path)))


@pytest.mark.parametrize("preset", ["chexpert", "covidx"])
def test_every_wanted_file_has_a_row(spark, tmp_path, preset):
    folder = tmp_path / "a folder+more"
    folder.mkdir()
    rng = np.random.default_rng(1)
    names = ["one.jpg", "two.JPG", "three.Jpeg", "with blank.jpg", "50%.jpg"]
    for n in names:
        write_jpeg(spark, folder / n, rng.integers(0, 255, (12, 9)).astype(np.uint8))
    (folder / "damaged.jpg").write_bytes(b"\xff\xd8\xff\xe0" + bytes(400))
    (folder / "note.txt").write_text("no image")
    root = str(tmp_path if preset == "chexpert" else folder)
    rows = {r.path.rsplit("/", 1)[-1]: r for r in prepare_folder(spark, root, preset, 8).collect()}
    wanted = {n for n in [*names, "damaged.jpg"]}
    assert set(rows) == wanted
    assert all((rows[n].height, rows[n].width, rows[n].error) == (8, 8, None) for n in names)
    assert rows["damaged.jpg"].error is not None
