"""Images embedded in HTML as base64 data."""

from __future__ import annotations

import base64
import binascii
import re

from tomeworks.functions.arrow import udf

_DATA = r"data:image/([^;]+);base64," + r"""([^"']+)["']"""
_IMAGE = re.compile(r"""<img[^>]*src=["']""" + _DATA + r"[^>]*/?\s*>", re.I)
_ALT = re.compile(r"""alt=["']([^"']*)["']""")
ENDINGS = {"png": ".png", "jpeg": ".jpg", "jpg": ".jpg", "gif": ".gif", "svg+xml": ".svg", "webp": ".webp"}
#: Characters of the tag that an alt text is looked for in.
ALT_RANGE = 200


def _decoded(data: str) -> bytes | None:
    try:
        return base64.b64decode(data)
    except (binascii.Error, ValueError):
        return None


def _alt(tag: str) -> str | None:
    m = _ALT.search(tag[:ALT_RANGE])
    return m[1] if m else None


def extract(html: str, base: str = "image") -> dict:
    """The HTML with links in place of images, and the images (name, data). What can't be decoded stays."""
    images: list[dict] = []
    n = 0

    def link(m: re.Match) -> str:
        nonlocal n
        n += 1
        data = _decoded(m[2])
        if data is None:
            return m[0]
        name = f"{base}_{n:03d}{ENDINGS.get(m[1], '.png')}"
        images.append({"name": name, "data": data})
        alt = _alt(m[0])
        return f"![{f'Image {n}' if alt is None else alt}]({name})"

    return {"html": _IMAGE.sub(link, html), "images": images}


def placeholders(html: str) -> str:
    """The HTML with a note of number, alt text, kind and size in place of each image."""
    n = 0

    def note(m: re.Match) -> str:
        nonlocal n
        n += 1
        data, alt = _decoded(m[2]), _alt(m[0])
        size = "unknown size" if data is None else f"{len(data) / 1024:.0f}KB" if len(data) >= 1024 else f"{len(data)} bytes"
        return f"[Image {n}{': ' + alt if alt else ''}: {m[1].upper().replace('+XML', '')}, {size}]"

    return _IMAGE.sub(note, html)


extract_images = udf(extract, "struct<html:string,images:array<struct<name:string,data:binary>>>")
with_placeholders = udf(placeholders, "string")
