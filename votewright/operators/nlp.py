"""Text preprocessing with a pluggable parser, one parse for all functions that share its settings."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import functions as F

from .labeling import LabelingFunction
from .mapping import Preprocessor, missing_parentheses
from .slicing import SlicingFunction

DOC = "struct<tokens:array<struct<text:string,lower:string,start:int,is_alpha:boolean,lemma:string,pos:string,is_punct:boolean,like_num:boolean>>,ents:array<struct<text:string,label:string>>>"
#: Parts of a parse that can be left out.
PARTS = ("ents", "lemma", "pos")
ENDINGS = (("ies", "y"), ("sses", "ss"), ("ing", ""), ("ed", ""), ("s", ""))
TOKEN = re.compile(r"\w+|[^\w\s]")
NAME = re.compile(r"\b[A-Z][a-z]+(?: [A-Z][a-z]+)+\b")

Parser = Callable[[str], dict[str, Any]]


#: Tokens kept in each worker, so that a frequent word is parsed once; those of longer words are made each time.
KEPT_TOKENS, KEPT_LENGTH = 1 << 16, 64
_kept: dict[str, dict[str, Any]] = {}


def token(word: str) -> dict[str, Any]:
    """The token of a word, as it is anywhere but at the start of a text."""
    lower, alpha, number = word.lower(), word.isalpha(), word.replace("_", "").isnumeric()
    sign = not (word[0].isalnum() or word[0] == "_")
    pos = "PUNCT" if sign else "NUM" if number else "PROPN" if word[0].isupper() else "X"
    made = {"text": word, "lower": lower, "start": 0, "is_alpha": alpha, "lemma": lemma(lower), "pos": pos, "is_punct": sign, "like_num": number}
    if len(word) <= KEPT_LENGTH:
        if len(_kept) >= KEPT_TOKENS:
            _kept.clear()
        _kept[word] = made
    return made


def simple_parser(text: str) -> dict[str, Any]:
    """Words and signs as tokens, with lemmas and parts of speech by rule; runs of capitalised words as entities of kind NAME."""
    tokens = []
    for t in TOKEN.finditer(text):
        word = t[0]
        one = (_kept.get(word) or token(word)).copy()
        one["start"] = t.start()
        tokens.append(one)
    if tokens and not tokens[0]["start"] and tokens[0]["pos"] == "PROPN":
        tokens[0]["pos"] = "X"
    return {"tokens": tokens, "ents": [{"text": e[0], "label": "NAME"} for e in NAME.finditer(text)]}


def lemma(word: str) -> str:
    """An English word without its commonest endings, if three letters stay; a rule, not a dictionary."""
    if not word.isalpha() or word.endswith("ss"):
        return word
    for ending, instead in ENDINGS:
        if word.endswith(ending) and len(word) - len(ending) + len(instead) >= 3:
            return word[: len(word) - len(ending)] + instead
    return word


def without_parts(doc: dict[str, Any], disable: tuple[str, ...]) -> dict[str, Any]:
    """A parse whose disabled parts are empty."""
    if not disable:
        return doc
    tokens = [{k: None if k in disable else v for k, v in t.items()} for t in doc["tokens"]]
    return {"tokens": tokens, "ents": [] if "ents" in disable else doc["ents"]}


#: Parsers by language; a third-party pipeline is plugged in as a function that makes a parser once in each worker.
PARSERS: dict[str, Callable[[], Parser]] = {"simple": lambda: simple_parser}


@dataclass(frozen=True)
class NLPSettings:
    text_field: str = "text"
    doc_field: str = "doc"
    language: str = "simple"
    disable: tuple[str, ...] = ()


def nlp_preprocessor(settings: NLPSettings | None = None, pre: list[Preprocessor] | None = None, **kw: Any) -> Preprocessor:
    """A preprocessor that adds the parsed ``doc_field`` (struct of tokens and entities); ``pre`` run before it."""
    s = settings or NLPSettings(**kw)
    if s.language not in PARSERS:
        raise ValueError(f"no parser for {s.language}; add one to PARSERS")
    if unknown := set(s.disable) - set(PARTS):
        raise ValueError(f"no parts of a parse: {sorted(unknown)}; known are {PARTS}")
    make, disable = PARSERS[s.language], tuple(s.disable)
    ready: list[Parser] = []

    def parse(pdf: pd.DataFrame) -> pd.DataFrame:
        if not ready:
            ready.append(make())
        return pd.DataFrame({s.doc_field: [None if t is None else without_parts(ready[0](t), disable) for t in pdf[s.text_field]]}, index=pdf.index)

    return Preprocessor(f"nlp_{s.doc_field}", parse, "pandas", [s.text_field], f"{s.doc_field} {DOC}", pre=pre or [])


_SHARED: dict[type, tuple[NLPSettings, Preprocessor]] = {}


def _shared(kind: type, settings: NLPSettings) -> Preprocessor:
    """One preprocessor for each kind of function; other settings than its first raise."""
    if kind not in _SHARED:
        _SHARED[kind] = (settings, nlp_preprocessor(settings))
    if _SHARED[kind][0] != settings:
        raise ValueError(f"{kind.__name__} is in use with different parameters: {_SHARED[kind][0]}")
    return _SHARED[kind][1]


class NLPLabelingFunction(LabelingFunction):
    """A row function that also sees the parsed text."""


class NLPSlicingFunction(SlicingFunction):
    """A slicing function that also sees the parsed text."""


def nlp_labeling_function(name: str | None = None, inputs: list[str] | None = None, resources: dict | None = None, pre: list | None = None, **settings: Any):
    missing_parentheses(name)
    s = NLPSettings(**settings)
    return lambda f: NLPLabelingFunction(name or f.__name__, f, "row", inputs or [s.text_field], resources or {}, [*(pre or []), _shared(NLPLabelingFunction, s)])


def nlp_slicing_function(name: str | None = None, inputs: list[str] | None = None, resources: dict | None = None, pre: list | None = None, **settings: Any):
    missing_parentheses(name)
    s = NLPSettings(**settings)
    return lambda f: NLPSlicingFunction(name or f.__name__, f, "row", inputs or [s.text_field], resources or {}, [*(pre or []), _shared(NLPSlicingFunction, s)])


def token_column(text: str = "text"):
    """Lower-case words of a text, without Python."""
    return F.filter(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+"), lambda w: w != "")
