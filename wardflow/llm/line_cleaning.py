"""Line-first cleaning: rules per line, then a verdict on what is left.

A line fails if it is *punctuation* (more than an eighth of its non-blank
characters are ASCII punctuation other than ``.,;:'"-()`` or digits' signs),
*navigation* (two or more ``|`` separators, with at most ``NAV_WORDS`` words to
each), or *boilerplate* (``PHRASES``, in any case, make up at least
``BOILERPLATE_SHARE`` of its words, so a mention in prose does no harm). Failing
lines are removed. A document goes if its base checks fail or if the removed
lines hold more than ``max_lost`` of its non-blank characters.

Defined results: a null or empty text has no words, fails the base check and
keeps a null or empty clean text. A null id, repeated rows and further columns
pass unchanged; a column named like the result is replaced. An empty table gives an
empty one. A very long text is a block of its own; memory follows the longest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StringType, StructType

from wardflow.llm import words as W
from wardflow.llm.carried import Carried

MAX_LOST = 0.5
MIN_WORDS = 50
PUNCTUATION_SHARE = 0.125
NAV_WORDS = 4
BOILERPLATE_SHARE = 0.15
# Phrases of site furniture and licences in English, German, French and Spanish.
PHRASES = (
    "all rights reserved", "licensed under", "released under the", "cookie policy",
    "accept cookies", "privacy policy", "terms of use", "terms of service",
    "terms and conditions", "enable javascript", "click here", "sign up for",
    "subscribe to our", "skip to content", "back to top", "share this", "lorem ipsum",
    "alle rechte vorbehalten", "lizenziert unter", "cookie-richtlinie", "cookies akzeptieren",
    "datenschutzerklärung", "nutzungsbedingungen", "hier klicken", "zum inhalt springen",
    "nach oben", "newsletter abonnieren", "javascript aktivieren",
    "tous droits réservés", "sous licence", "accepter les cookies", "politique de cookies",
    "politique de confidentialité", "conditions d'utilisation", "mentions légales",
    "cliquez ici", "aller au contenu", "haut de page", "abonnez-vous à",
    "todos los derechos reservados", "bajo licencia", "aceptar cookies",
    "política de cookies", "política de privacidad", "términos de uso",
    "términos y condiciones", "haga clic aquí", "saltar al contenido", "volver arriba",
    "suscríbete a",
)

FIELDS = (StructType()
          .add("n_words", LongType()).add("word_chars", LongType())
          .add("n_symbols", LongType()).add("n_dup_lines", LongType())
          .add("n_repeat_words", LongType()).add("base_failed", BooleanType())
          .add("n_lines", LongType()).add("n_punctuation", LongType())
          .add("n_navigation", LongType()).add("n_boilerplate", LongType())
          .add("chars", LongType()).add("lost_chars", LongType())
          .add("kept", BooleanType()))

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_ODD = np.zeros(256, bool)
_ODD[list(b"#*$%&<>!?@^~`_+=\\{}[]/|")] = True
_PHRASES = [p.encode() for p in PHRASES]


def _lines(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text of every line; the newline belongs to no line."""
    breaks = np.flatnonzero(data == 0x0A)
    text = np.concatenate([np.arange(len(bounds) - 1),
                           np.searchsorted(bounds, breaks, "right") - 1])
    starts = np.concatenate([bounds[:-1], breaks + 1])
    order = np.lexsort((starts, text))
    starts, text = starts[order], text[order]
    ends = np.empty_like(starts)
    last = np.ones(len(text), bool)
    last[:-1] = text[1:] != text[:-1]
    ends[last] = bounds[text[last] + 1]
    inner = np.flatnonzero(~last)
    ends[inner] = starts[inner + 1] - 1
    return starts, ends, text


def _spans(marks: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.zeros(len(marks) + 1, np.int64)
    np.cumsum(marks, out=total[1:])
    return total[ends] - total[starts]


def _measure(block: W.Block, max_lost: float, clean: bool) -> list:
    data, bounds = block.data, block.bounds
    n = len(bounds) - 1
    found = W.words(data, bounds)
    word = W.span_hashes(data, found.starts, found.ends)
    n_words = np.bincount(found.text, minlength=n)
    separator = W._SEPARATOR[data]
    heads = (data & 0xC0) != 0x80
    letters = ~separator & heads
    word_chars = W.per_text(letters, bounds)
    n_symbols = W.per_text(_SYMBOL[data], bounds)

    starts, ends, text = _lines(data, bounds)
    line_words = (np.searchsorted(found.starts, ends) - np.searchsorted(found.starts, starts))
    full = np.flatnonzero(line_words)
    line = W.span_hashes(data, starts[full], ends[full])
    _, earlier = W.repeated(W.mix(line + text[full].astype(np.uint64)))
    n_dup_lines = np.bincount(text[full][earlier], minlength=n)

    window, at = W.window_hashes(word, found.text, 3)
    twice, _ = W.repeated(W.mix(window + found.text[at].astype(np.uint64)))
    covered = np.zeros(len(word), bool)
    for k in range(3):
        covered[at[twice] + k] = True
    n_repeat = np.bincount(found.text[covered], minlength=n)
    base_failed = (n_words < MIN_WORDS) | (100 * n_repeat > 50 * n_words)

    chars = _spans(letters, starts, ends)
    odd = _spans(_ODD[data], starts, ends)
    pipes = _spans(data == ord("|"), starts, ends)
    punctuation = odd > PUNCTUATION_SHARE * chars
    navigation = (pipes >= 2) & (line_words <= (NAV_WORDS + 1) * (pipes + 1))
    phrase_words = np.zeros(len(starts), np.int64)
    # The bounds of texts and lines: a phrase counts only within one line.
    lower = W.LOWER[data].tobytes()
    for phrase in _PHRASES:
        at = lower.find(phrase)
        while at >= 0:
            k = int(np.searchsorted(starts, at, "right")) - 1
            at += len(phrase)
            if at <= ends[k]:
                phrase_words[k] += 1 + phrase.count(b" ")
            at = lower.find(phrase, at)
    boilerplate = (phrase_words > 0) & (phrase_words >= BOILERPLATE_SHARE * line_words)
    failed = (punctuation | navigation | boilerplate) & (line_words > 0)
    total = np.bincount(text, weights=chars, minlength=n).astype(np.int64)
    lost = np.bincount(text[failed], weights=chars[failed], minlength=n).astype(np.int64)
    kept = ~base_failed & (lost <= max_lost * total)

    lines = [np.bincount(text[x & (line_words > 0)], minlength=n)
             for x in (line_words > 0, punctuation, navigation, boilerplate)]
    counts = [n_words, word_chars, n_symbols, n_dup_lines, n_repeat, base_failed, *lines,
              total, lost, kept]
    if not clean:
        return counts
    gone: dict[int, list[int]] = {}
    for k in np.flatnonzero(failed):
        gone.setdefault(int(text[k]), []).append(k)
    raw = data.tobytes()
    cleaned = []
    first = np.searchsorted(text, np.arange(n + 1))
    for i in range(n):
        if i not in gone:
            cleaned.append(raw[bounds[i]:bounds[i + 1]].decode("utf-8", "replace"))
            continue
        rest = np.setdiff1d(np.arange(first[i], first[i + 1]), gone[i])
        cleaned.append(b"\n".join(raw[starts[k]:ends[k]] for k in rest).decode("utf-8", "replace"))
    return [*counts, np.array(cleaned, dtype=object)]


def clean_lines(docs: DataFrame, text: str = "text", name: str = "lines",
                max_lost: float = MAX_LOST, clean: bool = True) -> DataFrame:
    """``docs`` with a struct of counts and verdict.

    ``clean`` adds the field ``clean_text``, the text without failing lines.
    """
    types = [np.int64] * 5 + [bool] + [np.int64] * 6 + [bool] + [object] * clean
    fields = StructType([*FIELDS.fields])
    if clean:
        fields = fields.add("clean_text", StringType())

    def compute(column: pa.Array) -> list:
        out = W.joined([_measure(b, max_lost, clean) for b in W.blocks(column)], types)
        if clean:  # a null text stays null
            out[-1] = pa.array(out[-1], type=pa.string(), mask=column.is_null().to_numpy(
                zero_copy_only=False) if column.null_count else None)
        return out

    return W.add_struct(docs, text, name, fields, compute)


def kept_documents(docs: DataFrame, text: str = "text", chars: str = "n_chars") -> DataFrame:
    """The documents that stay, without their failing lines, in the same columns.

    A column ``chars``, if there is one, is the new texts' length. Null and empty texts
    go. All other columns pass, whatever their names.
    """
    carried = Carried(docs)
    column = carried[text]
    cleaned = (clean_lines(carried.rows, column, "_lines").filter("_lines.kept")
               .withColumn(column, F.col("_lines.clean_text")))
    if chars in carried.names:
        size = carried[chars]
        cleaned = cleaned.withColumn(
            size, F.length(column).cast(carried.rows.schema[size].dataType))
    return carried.back(cleaned)
