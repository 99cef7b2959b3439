"""Shared links in their normal form."""

import pytest
from pyspark.sql import functions as F

from gutterline.functions import names

CASES = {
    " Example.com ": ("https://example.com/", None),
    "HTTP://Example.COM:80/A b.cbz?x=1 2#Top": ("http://example.com/A%20b.cbz?x=1%202#Top", None),
    "https://example.com:443?": ("https://example.com/?", None),  # an empty query stays
    "https://me:pw@example.com:8443/x": ("https://me:pw@example.com:8443/x", None),
    "https://www.dropbox.com/s/a?dl=0&rlkey=k&raw=1#p": ("https://dl.dropboxusercontent.com/s/a?rlkey=k#p", None),
    "dropbox.com/s/a?dl=0": ("https://dl.dropboxusercontent.com/s/a", None),
    "https://github.com/u/r/blob/main/d/a.cbz": ("https://raw.githubusercontent.com/u/r/main/d/a.cbz", None),
    "https://github.com/u/r": ("https://github.com/u/r", None),
    "https://drive.google.com/file/d/1": (None, "linkDrive"),
    "ftp://example.com/a": (None, "linkInvalid"),
    "two words": (None, "linkInvalid"),
    "https://": (None, "linkInvalid"),
    "": (None, "linkEmpty"),
}


@pytest.fixture(scope="module")
def resolved(spark):
    rows = spark.createDataFrame([(t,) for t in CASES], "t string").select("t", names.resolve_link(F.col("t")).alias("r"))
    return {r.t: (r.r.url, r.r.error) for r in rows.collect()}


@pytest.mark.parametrize("text", CASES)
def test_link(resolved, text):
    assert resolved[text] == CASES[text]
