"""One-line license notices: words such as "released under", then the name of a license.

A notice is matched on plain words (lower case, no outer punctuation) joined by
spaces. Names are those of SPDX; one without a version is the family's alone,
since the text does not say which license of the family it is.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

_VERSION = r"(?:[ -](?:(?:version|ver|v\.?) ?)?|v)?(?P<{0}>[1-9](?:\.[0-9]){{0,2}})(?![\w.]*\w)(?P<{0}p>\+)?"
_LATER = r"(?: of the licen[sc]e)?(?:[ -]or(?: at your option)?(?: any)?[ -](?:later|newer|above)(?: version)?)"
_LICENSE = r"(?: (?:public )?licen[sc]e)?"

#: Families: SPDX name and wording. The first has the versions (GNU) that may go on with "or later".
_GNU = {
    "agpl": ("AGPL", r"(?:gnu )?(?:affero general public licen[sc]e(?: agpl)?|agpl)"),
    "lgpl": ("LGPL", r"(?:gnu )?(?:(?:lesser|library) general public licen[sc]e(?: lgpl)?|lgpl)"),
    "gpl": ("GPL", r"(?:gnu )?(?:general public licen[sc]e(?: gpl)?|gpl)"),
}
_VERSIONED = {
    "apache": ("Apache", rf"apache(?: software)?{_LICENSE}"),
    "mpl": ("MPL", r"(?:mozilla public licen[sc]e(?: mpl)?|mpl)"),
    "epl": ("EPL", r"(?:eclipse public licen[sc]e(?: epl)?|epl)"),
    "eupl": ("EUPL", r"(?:european union public licen[sc]e(?: eupl)?|eupl)"),
    "bsl": ("BSL", r"(?:boost software licen[sc]e|bsl)"),
    "artistic": ("Artistic", rf"artistic{_LICENSE}"),
}
_FIXED = {
    "BSD-2-Clause": rf"(?:(?:2|two)-clause bsd{_LICENSE}|bsd[ -](?:2|two)[ -]clause{_LICENSE}|(?:simplified|freebsd) bsd{_LICENSE})",
    "BSD-3-Clause": rf"(?:(?:3|three)-clause bsd{_LICENSE}|bsd[ -](?:3|three)[ -]clause{_LICENSE}|(?:new|modified|revised) bsd{_LICENSE})",
    "0BSD": rf"(?:0bsd|zero-clause bsd){_LICENSE}",
    "BSD": rf"bsd{_LICENSE}",
    "MIT": rf"mit(?:[ ]?x11)?{_LICENSE}",
    "ISC": rf"isc{_LICENSE}",
    "Zlib": rf"zlib{_LICENSE}",
    "Unlicense": r"unlicense",
    "WTFPL": r"wtfpl",
    "CC0-1.0": r"(?:creative commons (?:cc0|zero)|cc zero|cc0)(?:[ -]1\.0)?(?: universal)?(?: public domain dedication)?",
}
_CC = (
    r"(?:creative commons|cc)[ -](?P<cc>attribution|by)(?P<ccx>(?:[ -]?(?:(?:non-?commercial|nc)|(?:share-?alike|sa)|(?:no-?deriv(?:ative)?s|nd))(?![a-z]))*)"
    r"(?:" + _VERSION.format("ccv") + r")?(?: (?:international|unported|generic))?" + _LICENSE
)


def _names() -> str:
    parts = [f"(?:{_CC})"]
    for key, (_, wording) in _GNU.items():
        parts.append(f"(?P<{key}>{wording}(?: as published by the free software foundation)?(?: either)?(?:{_VERSION.format(key + 'v')})?(?P<{key}l>{_LATER})?(?:-only)?)")
    for key, (_, wording) in _VERSIONED.items():
        parts.append(f"(?P<{key}>{wording}(?:{_VERSION.format(key + 'v')})?)")
    for k, wording in enumerate(_FIXED.values()):
        parts.append(f"(?P<f{k}>{wording})")
    before = rf"(?:(?:version|v) ?(?P<pre>[1-9](?:\.[0-9])?)(?P<prel>{_LATER})? of (?:the )?)?"
    return rf"{before}(?:{'|'.join(parts)})(?!\S)"


_FILL = r"(?: (?:either|both|one|any|of|the|a|an|terms|conditions|and|permissive|following|open|source))*"
#: Words that begin a notice.
_LEAD = (
    r"(?<!\S)(?:this [\w.-]+ is )?(?:(?:dual-?|re-?)?licen[sc]ed|released|distributed|made available|available|published|provided|offered)"
    rf"(?: to you)? under{_FILL}(?= )"
)
_LEAD_RE, _NAME_RE = re.compile(_LEAD), re.compile(_names())
_NEXT_RE = re.compile(rf" (?:and|or|andor|plus)(?: (?:also|under|licen[sc]ed))*{_FILL}(?= )")
_SPDX_RE = re.compile(r"(?<!\S)spdx-license-identifier(?!\S)")
_SPDX_ID = re.compile(r" (?:(?:and|or) )?(?P<id>[a-z0-9][a-z0-9.+-]*)(?!\S)(?P<more>(?: with \S+)?)")
_SPDX_JOIN = re.compile(r" (?:and|or)(?= )")

SPDX = {
    n.lower(): n
    for n in (
        "0BSD AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.1 Apache-2.0 Artistic-2.0 BSD-2-Clause BSD-3-Clause BSL-1.0 CC0-1.0 CC-BY-3.0 CC-BY-4.0 "
        "CC-BY-SA-3.0 CC-BY-SA-4.0 CC-BY-NC-4.0 CC-BY-ND-4.0 CC-BY-NC-SA-4.0 CC-BY-NC-ND-4.0 EPL-1.0 EPL-2.0 EUPL-1.2 GPL-2.0 GPL-2.0-only GPL-2.0-or-later "
        "GPL-3.0 GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later MIT MPL-1.1 MPL-2.0 "
        "Unlicense WTFPL Zlib"
    ).split()
}


def _full(version: str) -> str:
    return version if "." in version else f"{version}.0"


def _name_of(m: re.Match) -> str:
    g = m.groupdict()
    if g["cc"]:
        kind = g["ccx"].replace("-", "").replace(" ", "")
        marks = [mark for mark, wording in (("NC", "noncommercial|nc"), ("SA", "sharealike|sa"), ("ND", "noderiv|nd")) if re.search(wording, kind)]
        return "-".join(["CC-BY", *marks, *([_full(g["ccv"])] if g["ccv"] else [])])
    for key, (name, _) in _GNU.items():
        if g[key]:
            version = g[f"{key}v"] or g["pre"]
            if version is None:
                return name
            later = g[f"{key}l"] or g[f"{key}vp"] or g["prel"]
            return f"{name}-{_full(version)}-{'or-later' if later else 'only'}"
    for key, (name, _) in _VERSIONED.items():
        if g[key]:
            version = g[f"{key}v"] or g["pre"]
            return f"{name}-{_full(version)}" if version else name
    return next(name for k, name in enumerate(_FIXED) if g[f"f{k}"])


def notices(plain: list[str]) -> list[tuple[str, int, int]]:
    """Name, first word and end of each notice in plain words; empty ones (comment marks) may lie in between."""
    at = [i for i, w in enumerate(plain) if w]
    text = " ".join(plain[i] for i in at)
    begins, p = [], 0
    for i in at:
        begins.append(p)
        p += len(plain[i]) + 1
    out = []

    def add(name: str, start: int, end: int) -> None:
        out.append((name, at[bisect_right(begins, start) - 1], at[bisect_left(begins, end) - 1] + 1))

    for lead in _LEAD_RE.finditer(text):
        start, end = lead.start(), lead.end()
        while (name := _NAME_RE.match(text, end + 1)) is not None:
            add(_name_of(name), start, name.end())
            further = _NEXT_RE.match(text, name.end())
            if further is None:
                break
            start = end = further.end()
            start += 1
    for lead in _SPDX_RE.finditer(text):
        start, end = lead.start(), lead.end()
        while (name := _SPDX_ID.match(text, end)) is not None:
            known = name["id"].removesuffix("+")
            if known not in SPDX and not re.search("[0-9-]", known):
                break
            known = SPDX.get(known, known) + name["id"][len(known) :]
            add(known, start, name.end())
            if (join := _SPDX_JOIN.match(text, name.end())) is None:
                break
            end = join.end()
            start = end + 1
    return out
