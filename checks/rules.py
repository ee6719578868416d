"""The public suffix list that Spark itself ships, inside the archive of its HTTP client."""

from __future__ import annotations

import glob
import os
import zipfile
from functools import lru_cache

import pyspark

from hostlens.functions.suffix import END_OF_PUBLIC_PART

ENTRY = "mozilla/public-suffix-list.txt"


@lru_cache(maxsize=1)
def public_list() -> str:
    """The list's text, as its file has it."""
    home = os.environ.get("SPARK_HOME") or os.path.dirname(pyspark.__file__)
    for path in sorted(glob.glob(os.path.join(home, "jars", "httpclient-*.jar"))):
        with zipfile.ZipFile(path) as archive:
            if ENTRY in archive.namelist():
                return archive.read(ENTRY).decode("utf-8")
    raise FileNotFoundError(f"no {ENTRY} in the archives of {home}")


def rule_lines() -> list[str]:
    """The rules of the list's public part, in file order."""
    lines = public_list().split(END_OF_PUBLIC_PART)[0].splitlines()
    return [line.split()[0] for line in lines if line.strip() and not line.startswith("//")]
