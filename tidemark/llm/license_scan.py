"""License scans by ordered signature rules.

The text becomes its words (lower-case runs of letters and digits) joined by single spaces. Rules are regular expressions over
that, made of LICENSES (a label, keywords of which every mention has one as a word, and the name's expression) and FORMS (how a
text speaks of a license, with a priority and a confidence). A rule is tried only where one of its keywords occurs. Detections are then resolved: by
priority, then length, then place, each is kept unless it lies inside one already kept. Base phrases are counted besides at
every place where their words stand consecutively, and their labels always stay.

Rows: null, empty and wordless texts have no words, labels '' and score 0. Repeated rows give one row each. Ties between
detections go to the longer, the earlier, then the first label. Texts of any length are scanned whole, in time that follows their
length and detections. An empty table gives no rows. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import defaultdict

from pyspark.sql import DataFrame

from .text import alnum_words, map_rows

# Fixed values of the contract.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"

#: What stands between a name and its number, the space included: "version 2", "v2", "v 2" or nothing.
_V = r"(?: version)? (?:v ?)?"


def _short(name: str, version: str, first: str = "") -> tuple[str, str]:
    """Keywords and expression of an abbreviated name with its version, apart or joined: gpl 2, gpl2, gplv2, gpl version 2 0."""
    first = first or version.split()[0]
    return f"{name} {name}{first} {name}v {name}v{first}", rf"(?:gnu )?{name}(?: version)? ?(?:v ?)?{version}" + ("" if " " in version else "(?: 0)?")


#: label: keywords, name. Variants come before what they extend only by length; containment decides between them.
LICENSES = {
    "mit": ("mit expat", r"(?:mit|expat|mit x11)"),
    "mit-0": ("mit", r"mit (?:0|no attribution)"),
    "apache-1.1": ("apache", r"apache(?: software)?(?: license)?" + _V + r"1 1"),
    "apache-2": ("apache", r"apache(?: software)?(?: license)?" + _V + r"2(?: 0)?"),
    "bsd-2-clause": ("bsd", r"(?:simplified|freebsd|2 clause|two clause) bsd|bsd 2 clause"),
    "bsd-3-clause": ("bsd", r"(?:new|modified|revised|3 clause|three clause) bsd|bsd 3 clause"),
    "bsd-4-clause": ("bsd", r"(?:original|old|4 clause|four clause) bsd|bsd 4 clause"),
    "bsd": ("bsd", r"bsd(?: style)?"),
    "0bsd": ("bsd 0bsd", r"(?:zero clause bsd|bsd zero clause|0bsd)"),
    "isc": ("isc", r"isc"),
    "gpl-1": ("gnu", r"gnu general public license" + _V + r"1(?: 0)?"),
    "gpl-2": ("gnu", r"gnu general public license" + _V + r"2(?: 0)?"),
    "gpl-3": ("gnu", r"gnu general public license" + _V + r"3(?: 0)?"),
    "gpl": ("gnu", r"gnu general public license"),
    "gpl-1-short": _short("gpl", "1"),
    "gpl-2-short": _short("gpl", "2"),
    "gpl-3-short": _short("gpl", "3"),
    "lgpl-2-short": _short("lgpl", "2"),
    "lgpl-2.1-short": _short("lgpl", "2 1"),
    "lgpl-3-short": _short("lgpl", "3"),
    "agpl-3-short": _short("agpl", "3"),
    "mpl-1.1-short": _short("mpl", "1 1"),
    "mpl-2-short": _short("mpl", "2"),
    "epl-1-short": _short("epl", "1"),
    "epl-2-short": _short("epl", "2"),
    "fdl-short": ("gfdl", r"(?:gnu )?gfdl(?:" + _V + r"1 [123])?"),
    "boost-short": ("bsl", r"bsl 1 0"),
    "artistic-1": ("artistic", r"artistic 1 0"),
    "artistic-2-short": ("artistic", r"artistic 2 0"),
    "psf-short": ("psf", r"psf 2 0"),
    "odbl-short": ("odbl", r"odbl(?:" + _V + r"1 0)?"),
    "ofl-short": ("ofl", r"ofl(?:" + _V + r"1 [01])"),
    "eupl-short": _short("eupl", "1 [012]", "1"),
    "lgpl-2": ("gnu", r"gnu library general public license" + _V + r"2(?: 0)?"),
    "lgpl-2.1": ("gnu", r"gnu lesser general public license" + _V + r"2 1"),
    "lgpl-3": ("gnu", r"gnu lesser general public license" + _V + r"3(?: 0)?"),
    "lgpl": ("gnu", r"gnu (?:lesser|library) general public license"),
    "agpl-3": ("gnu", r"gnu affero general public license" + _V + r"3(?: 0)?"),
    "agpl": ("gnu", r"gnu affero general public license"),
    "fdl": ("gnu", r"gnu free documentation license(?:" + _V + r"1 [123])?"),
    "mpl-1.1": ("mozilla", r"mozilla public license" + _V + r"1 1"),
    "mpl-2": ("mozilla", r"mozilla public license" + _V + r"2(?: 0)?"),
    "mpl": ("mozilla", r"mozilla public license"),
    "epl-1": ("eclipse", r"eclipse public license" + _V + r"1(?: 0)?"),
    "epl-2": ("eclipse", r"eclipse public license" + _V + r"2(?: 0)?"),
    "cddl": ("cddl common", r"(?:common development and distribution license|cddl)(?:" + _V + r"1 [01])?"),
    "cc0": ("cc0", r"(?:creative commons )?cc0(?: 1 0)?"),
    "cc-by": ("cc", r"(?:creative commons )?cc by(?: [1234] 0)?"),
    "cc-by-sa": ("cc", r"(?:creative commons )?cc by sa(?: [1234] 0)?"),
    "cc-by-nd": ("cc", r"(?:creative commons )?cc by nd(?: [1234] 0)?"),
    "cc-by-nc": ("cc", r"(?:creative commons )?cc by nc(?: [1234] 0)?"),
    "cc-by-nc-sa": ("cc", r"(?:creative commons )?cc by nc sa(?: [1234] 0)?"),
    "cc-by-nc-nd": ("cc", r"(?:creative commons )?cc by nc nd(?: [1234] 0)?"),
    "cc-attribution": ("creative", r"creative commons attribution(?: [1234] 0)?"),
    "cc-attribution-sa": ("creative", r"creative commons attribution share ?alike(?: [1234] 0)?"),
    "cc-attribution-nc": ("creative", r"creative commons attribution non ?commercial(?: [1234] 0)?"),
    "cc-attribution-nc-sa": ("creative", r"creative commons attribution non ?commercial share ?alike(?: [1234] 0)?"),
    "cc-attribution-nd": ("creative", r"creative commons attribution no ?deriv(?:ative)?s?(?: works)?(?: [1234] 0)?"),
    "unlicense": ("unlicense", r"unlicense"),
    "wtfpl": ("wtfpl", r"wtfpl"),
    "zlib": ("zlib", r"zlib(?: libpng)?"),
    "boost": ("boost", r"boost software license(?:" + _V + r"1 0)?"),
    "artistic-2": ("artistic", r"artistic license" + _V + r"2(?: 0)?"),
    "artistic": ("artistic", r"artistic license"),
    "psf": ("python", r"python software foundation license(?:" + _V + r"2)?"),
    "openssl": ("openssl", r"openssl license"),
    "postgresql": ("postgresql", r"postgresql license"),
    "odbl": ("database", r"open (?:data commons open )?database license(?: odbl)?(?:" + _V + r"1 0)?"),
    "ofl": ("font", r"sil open font license(?:" + _V + r"1 [01])?"),
    "eupl": ("european", r"european union public licen[cs]e(?:" + _V + r"1 [012])?"),
    "public-domain": ("public", r"public domain"),
}
#: Labels that are spelt in several ways.
SAME = {k: k.removesuffix("-short") for k in LICENSES if k.endswith("-short")} | {"artistic-1": "artistic", "cc-attribution": "cc-by", "cc-attribution-sa": "cc-by-sa", "cc-attribution-nc": "cc-by-nc", "cc-attribution-nc-sa": "cc-by-nc-sa", "cc-attribution-nd": "cc-by-nd"}
#: form: priority, confidence, expression around the name.
FORMS = {
    "tag": (5, 1.0, r"spdx license identifier (?:{})(?: only| or later)?"),
    "grant": (4, 0.95, r"(?:licensed|released|distributed|available|published|provided|offered|covered|dual licensed|redistributed) under (?:the )?(?:terms (?:and conditions )?of )?(?:the )?(?:{})(?: licen[cs]e)?(?: or later)?"),
    "field": (3, 0.9, r"licen[cs]e(?: type| name| is)? (?:the )?(?:{})(?: licen[cs]e)?(?: or later)?"),
    "title": (2, 0.7, r"(?:the )?(?:{}) licen[cs]e"),
    "mention": (1, 0.4, r"(?:{})"),
}
#: Names so short or so common that a bare mention tells nothing.
WEAK = frozenset(["mit", "isc", "bsd", "zlib", "public-domain"])


class Rule:
    __slots__ = ("label", "priority", "confidence", "find")

    def __init__(self, label: str, priority: int, confidence: float, expression: str):
        self.label, self.priority, self.confidence = label, priority, confidence
        self.find = re.compile(f"(?<= ){expression}(?= )".encode()).finditer


def make_rules() -> dict[tuple[bytes, ...], list[Rule]]:
    """Rules by keywords: every form of every license, but no bare mention of weak names."""
    rules = defaultdict(list)
    for label, (keywords, name) in LICENSES.items():
        for form, (priority, confidence, around) in FORMS.items():
            if form != "mention" or label not in WEAK:
                key = tuple(f" {k} ".encode() for k in keywords.split())
                rules[key].append(Rule(SAME.get(label, label), priority, confidence, around.format(name)))
    return dict(rules)


def resolve(found: list[tuple[int, int, int, float, str]]) -> list[tuple[int, int, int, float, str]]:
    """Of (priority, start, end, confidence, label): by priority, length and place, those not inside one already kept.

    The kept intervals that are inside no other kept one stand sorted by start, and so by end: only the last that begins at or
    before a detection can hold it.
    """
    kept, starts, ends = [], [], []
    for d in sorted(found, key=lambda d: (-d[0], d[1] - d[2], d[1], d[4])):
        k = bisect_right(starts, d[1])
        if k and d[2] <= ends[k - 1]:
            continue
        kept.append(d)
        stop = k  # outer intervals replace those that they hold
        k = bisect_left(starts, d[1])
        while stop < len(starts) and ends[stop] <= d[2]:
            stop += 1
        starts[k:stop], ends[k:stop] = [d[1]], [d[2]]
    return kept


class Scanner:
    def __init__(self):
        self.rules = make_rules()
        self.base = [(f" {phrase} ".encode(), label) for phrase, label in BASE.items()]

    def scan(self, text: str | None) -> dict:
        words = alnum_words(text)
        flat = b" " + b" ".join(words) + b" "
        starts, base = [], set()
        for phrase, label in self.base:
            at = flat.find(phrase)
            while at >= 0:
                starts.append(at)
                base.add(label)
                at = flat.find(phrase, at + 1)
        found = [(r.priority, *m.span(), r.confidence, r.label) for keys, rules in self.rules.items() if any(k in flat for k in keys) for r in rules for m in r.find(flat)]
        kept = resolve(found)
        score = 1.0
        for *_, confidence, _ in kept:
            score *= 1 - confidence
        return {
            "n_words": len(words), "n_base": len(starts), "first_word": flat.count(b" ", 0, min(starts)) if starts else None, "last_word": flat.count(b" ", 0, max(starts)) if starts else None,
            "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(base | {d[4] for d in kept})), "score": 1 - score if kept else 0.9 if base else 0.0,
        }


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id and the columns of SCHEMA for each row of docs (doc_id, text)."""

    def start():
        scanner = Scanner()

        def work(ids, texts):
            rows = [scanner.scan(t) for t in texts]
            return {"doc_id": ids, **{k: [r[k] for r in rows] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")}}

        return work

    return map_rows(docs.select("doc_id", "text"), SCHEMA, start)
