"""Public suffixes: a list of registries' and platforms' suffixes, as one pattern that expressions match.

The list is the one that comes with Spark's own HTTP client, unless another file is given to
``use_list``. All its rules count: plain ones, wildcards (``*.ck``) and exceptions (``!www.ck``), and
both sections, registries (``ICANN``) and platforms (``PRIVATE``).

The rules (about 8,000 of registries) become a pattern over the reversed name, shared beginnings written once: a match takes some
hundred steps whatever the number of rules, in generated code, and a use costs the plan one text of some 70 kB. The longest rule
that fits counts, an exception before a wildcard.
"""

from __future__ import annotations

import glob
import os
import re
import zipfile
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

_chosen: str | None = None


def use_list(path: str | None) -> None:
    """Take the rules from a public-suffix list file on the driver; None: from the list that comes with Spark."""
    global _chosen
    _chosen = path


def _text(path: str | None) -> str:
    if path:
        with open(path, encoding="utf-8") as f:
            return f.read()
    import pyspark

    home = os.environ.get("SPARK_HOME") or os.path.dirname(pyspark.__file__)
    for jar in sorted(glob.glob(os.path.join(home, "jars", "httpclient-4*.jar"))):
        with zipfile.ZipFile(jar) as z:
            return z.read("mozilla/public-suffix-list.txt").decode()
    raise FileNotFoundError("Spark comes without a public-suffix list here: give one to use_list")


def _ascii(rule: str) -> str:
    """The rule in the form that names have in the DNS."""
    try:
        return ".".join(x if x in ("*", "") or x.isascii() else x.encode("idna").decode() for x in rule.split("."))
    except UnicodeError:
        return rule


@lru_cache(maxsize=4)
def _rules(path: str | None) -> tuple[frozenset[str], frozenset[str]]:
    parts = _text(path).split("===BEGIN PRIVATE DOMAINS===")
    out = []
    for part in (parts[0], "".join(parts[1:])):
        own = {line.split()[0].lower() for line in part.splitlines() if line.strip() and not line.startswith("//")}
        out.append(frozenset(own | {_ascii(r) for r in own}))
    return out[0], out[1]


def rules(private: bool = False) -> frozenset[str]:
    """The registries' rules, and with ``private`` the platforms' as well."""
    icann, own = _rules(_chosen)
    return icann | own if private else icann


def _joined(words: dict[str, str]) -> str:
    """A pattern of words, each with what follows it; shared beginnings are written once, longer words stand first."""
    by: dict[str, dict[str, str]] = {}
    for w, then in words.items():
        by.setdefault(w[:1], {})[w[1:]] = then
    out = [(re.escape(c) + _joined(own) if c else own[""]) for c, own in sorted(by.items(), reverse=True)]
    return out[0] if len(out) == 1 else "(?:" + "|".join(out) + ")"


@lru_cache(maxsize=8)
def _pattern(path: str | None, private: bool) -> str:
    """The pattern of a suffix at the beginning of a reversed name; a dot ends every label, the last one too."""
    tree: dict = {}
    for r in rules(private):
        node = tree
        for label in reversed(r.lstrip("!").split(".")):
            node = node.setdefault(label[::-1], {})
        node["!" if r.startswith("!") else ""] = {}

    def label(node: dict) -> str:
        """What follows a label: its dot, and the rules below it."""
        below = {k: v for k, v in node.items() if k not in ("", "!")}
        tries = ["(?=" + re.escape(k) + r"\.)" for k, v in sorted(below.items()) if "!" in v]
        if named := {k: label(v) for k, v in below.items() if k != "*" and "!" not in v}:
            tries.append(_joined(named))
        if "*" in below:
            tries.append("[^.]+" + label(below["*"]))
        return r"\." + ("(?:" + "|".join(tries) + ")" + "?" * ("" in node) if tries else "")

    return _joined({k: label(v) for k, v in tree.items()}) if tree else "(?!)"


def pattern(private: bool = False) -> str:
    return "(?>" + _pattern(_chosen, private) + ")"


def backwards(name: Column) -> Column:
    """The reversed name with a dot after its last label: what the patterns read."""
    return F.concat(F.reverse(name), F.lit("."))


def taken(name: Column, more: str, private: bool = False) -> Column:
    """Of a lower-cased name, its public suffix and what the pattern ``more`` reads in the reversed name before it; empty where they do not fit."""
    return F.substring(F.reverse(F.regexp_extract(backwards(name), "^" + pattern(private) + more, 0)), 2, 1 << 20)


def below(name: Column) -> Column:
    """The label before a lower-cased name's public suffix; empty without one."""
    return F.reverse(F.regexp_extract(backwards(name), "^" + pattern() + r"([^.]*)\.", 1))


@lru_cache(maxsize=4)
def _heads(path: str | None) -> tuple[str, str]:
    """Of all rules those that no shorter rule begins, one label and more: together they say whether any rule fits."""
    every = rules(True)
    heads = sorted(r for r in every if not r.startswith("!") and not any(".".join(r.split(".")[i:]) in every for i in range(1, r.count(".") + 1)))
    return "|".join(r for r in heads if "." not in r), "|".join(re.escape(r).replace(r"\*", "[^.]+") for r in heads if "." in r)


def is_known(name: Column) -> Column:
    """Some rule of either section fits the lower-cased name."""
    more = _heads(_chosen)[1]
    return is_top_level(F.substring_index(name, ".", -1)) | name.rlike(rf"(?:^|\.)(?:{more or '(?!)'})$")


def is_top_level(name: Column) -> Column:
    """A lower-cased name of one label that is itself a suffix."""
    one = _heads(_chosen)[0]
    return (name != "") & ~name.contains(".") & ~name.contains("|") & (F.instr(F.lit(f"|{one}|"), F.concat(F.lit("|"), name, F.lit("|"))) > 0)


def is_listed(name: Column) -> Column:
    """The lower-cased name is itself a suffix of either section."""
    return F.regexp_extract(F.concat(backwards(name), F.lit("x.")), "^" + pattern(private=True) + r"x\.$", 0) != ""
