"""Secrets in texts: candidates by pattern, false ones removed by a random forest.

A candidate is the base64 body of a PEM block, a value of 6 or more characters
after ``=`` or ``:`` (a name and its ``=`` are never part of it), or a longest run
of 8 or more letters, digits and ``+/_-``, also of several joined by dots. It
holds a letter and a digit unless its name is that of a credential. A forest
trained on labelled findings judges it by its length, character transitions,
dictionary coverage, path and neighbouring words. The trees are compiled into
column expressions, so texts are scanned by built-in functions alone, in one pass
and without a shuffle.

Labelled findings are rows of ``candidate``, ``before``, ``after``, ``label``.
``labelled_findings`` makes them by scanning a fixed number of whole lines made
from hashes, in the settings in which such strings are and are not secrets; other
findings may be added.

Defined results: null and empty texts have no findings. A secret that occurs
twice is two findings. The body of a PEM block is one finding, its lines parted by
line feeds, and counts as one word. All rows and columns pass; a column named like
the result is replaced. Texts and values may be of any length; an empty table gives
no findings.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardflow.llm.carried import Carried
from wardflow.session import settle

LABELLED_ROWS = 4000
TREES = 15
DEPTH = 5
THRESHOLD = 0.5
MASK = "[SECRET]"
# Characters of a word before a candidate that are looked at, and of each word before it.
CONTEXT = 200

# Repeated groups are possessive, which Java matches in a loop; others it matches by
# recursion, and a long value would overflow the stack.
_BODY = r"[A-Za-z0-9+/_\-]"
_PLAIN = (rf"(?<!{_BODY})(?:[A-Z]{{2,4}}\.)?{_BODY}{{8,}}+(?:\.{_BODY}{{8,}}+)*+"
          r"(?:={1,2}(?![A-Za-z0-9+/_=\-]))?")
_GLUE = "\x01"  # stands for the line ends in a PEM block
# A value may hold more symbols. An @ before a host ends it, and no dot or @ is its last.
_INNER = r"(?:\.|@(?![a-z0-9.\-]++[:/]))"
_LAST = r"[A-Za-z0-9+/_~!#$%^*|\-]"
_VALUE = (rf"(?<=[=:][\"'`]?)(?!//)(?=(?:{_INNER}|{_LAST}){{5}}{_INNER}*+{_LAST})"
          rf"(?:{_INNER}*+{_LAST}++)++={{0,2}}")
_RUN = rf"(?<={_GLUE})[A-Za-z0-9+/={_GLUE}]*[A-Za-z0-9+/=]|{_VALUE}|{_PLAIN}"
# Texts without this have no candidate.
_ANY = (r"[=:][\x20\x09-\x0D\"'`]*+[^\x20\x09-\x0D\"'`]{6}|-----BEGIN |"
        rf"(?<!{_BODY})(?=[A-Za-z+/_\-]*+[0-9]){_BODY}{{8}}")
_LINE_END = r"(?:\s|\\[rn])++"
# The first line of a PEM block with its headers, then one line of base64 at a time.
_BLOCK = (r"(?:(-----BEGIN [A-Z0-9 ]+-----)(?:\s+[A-Za-z\-]+: [^\r\n]*+)*+|(?!\A)\G"
          rf"([A-Za-z0-9+/]{{40,}}+={{0,2}}|=?[A-Za-z0-9+/]++={{0,2}}(?={_LINE_END}-----END)))"
          + _LINE_END)
_SPACE = r"[\x20\x09-\x0D]+"
_ASSIGNED = r"[=:]>?\s*[\"'`]?$"
_CREDENTIAL = (r"(?i)(token|secret|passw|passphrase|[_\-.]pass\b|pwd|api.?key|access.?key|auth|"
               r"bearer|credential|private|(signing|encryption|account|master).?key|"
               r"kennwort|geheim|zugangscode|contrase|clave|secreto|credencial|"
               r"\bpasse\b|\bmdp\b|cl[eé].?(secr|priv|api)|jeton|"
               r"://[^\s/@:]+:$)")
_PREFIX = (r"^(sk[-_]|pk_live|rk_live|gh[pousr]_|github_pat_|glpat-|xox[abprs]-|AKIA|ASIA|AIza|"
           r"eyJ[A-Za-z0-9_\-]+\.|SG\.|npm_|hf_)")
_BENIGN = r"(?i)(commit|sha\d|md5|checksum|digest|hash|uuid|version|image|href|src|build|rev|etag)"
# Frequent pairs of letters and words of running text.
_PAIRS = ("th|he|in|er|an|re|on|at|en|nd|ti|es|or|te|of|ed|is|it|al|ar|st|to|nt|ng|se|ha|as|ou|"
          "io|le|ve|co|me|de|hi|ri|ro|ic|ne|ea|ra|ce|li|ch|ll|be|ma|si|om|ur")
_DICTIONARY = ("example|placeholder|changeme|your|test|sample|dummy|default|config|setting|"
               "version|document|service|client|server|project|package|module|static|public|"
               "private|image|index|value|number|string|object|content|system|license|this|that|"
               "with|from|have|which|there|their|about|would|these|other|into|could|the|and|for|"
               "not|are|was|but|all|can|had|her|one|our|out|has|key|token|secret|name|user|data")

FEATURES = [
    "length", "digits", "uppers", "lowers", "symbols", "transitions", "letter_pairs",
    "dictionary", "hexadecimal", "repeats", "slashes", "path", "assigned", "quoted",
    "credential", "benign", "prefixed", "block",
]


def _share(text: Column, kept: str) -> Column:
    return F.length(F.regexp_replace(text, kept, "")) / F.length(text)


def _is_credential(before: Column) -> Column:
    """Whether the name before a value is that of a credential: other pairs do not count."""
    return F.regexp_extract(before, r"[^&;,?{}()<>]*$", 0).rlike(_CREDENTIAL)


def _features(c: Column, before: Column, after: Column) -> list[Column]:
    """Numbers of a finding, in the order of ``FEATURES``."""
    n = F.length(c)
    lower = F.lower(c)
    assigned = before.rlike(_ASSIGNED)
    name = F.when(assigned, F.regexp_extract(before, r"[^\s&;,?]*\s*[=:]+>?\s*[\"'`]?$", 0)
                  ).otherwise(before)
    # A mark for each place where the kind of character changes.
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(
        c, "[a-z]+", "a"), "[A-Z]+", "b"), "[0-9]+", "c"), "[^abc]+", "d")
    values = [
        n, _share(c, "[^0-9]"), _share(c, "[^A-Z]"), _share(c, "[^a-z]"),
        _share(c, "[A-Za-z0-9]"), (F.length(kinds) - 1) / n,
        1.0 - F.length(F.regexp_replace(lower, _PAIRS, "")) / n,
        1.0 - F.length(F.regexp_replace(lower, _DICTIONARY, "")) / n,
        _share(lower, "[^0-9a-f]"), 1.0 - F.length(F.regexp_replace(c, r"(.)\1+", "$1")) / n,
        F.length(F.regexp_replace(c, "[^/]", "")),
        (before.rlike(r"[/\\.:]$|https?:|www\.") & ~assigned)
        | after.rlike(r"^\.[a-z]{2,4}\b|^/"),
        assigned, before.rlike("[\"'`]$") & after.rlike("^[\"'`]"),
        _is_credential(before), name.rlike(_BENIGN), c.rlike(_PREFIX), before.endswith(_GLUE),
    ]
    return [v.cast("double") for v in values]


def labelled_lines(spark: SparkSession, rows: int = LABELLED_ROWS) -> DataFrame:
    """Lines (``text``) with a ``value`` that is a secret or not: hashes and words."""
    hashed = spark.range(rows, numPartitions=4).select(
        "id", F.sha1(F.concat(F.lit("a"), F.col("id").cast("string")).cast("binary")).alias("hex"),
        F.regexp_replace(F.base64(F.unhex(F.sha2(F.col("id").cast("string").cast("binary"), 256))),
                         "=", "").alias("b64"))

    def pick(*values, shift: int = 0) -> Column:
        return F.element_at(F.array(*[v if isinstance(v, Column) else F.lit(v) for v in values]),
                            (F.pmod(F.xxhash64("id", F.lit(shift)), F.lit(len(values))) + 1)
                            .cast("int"))

    url64 = F.translate("b64", "+/", "-_")
    keyed = F.concat(pick("sk-", "ghp_", "AKIA", "xoxb-", "glpat-", "AIza", "sk_live_", shift=20),
                     pick(F.regexp_replace("b64", "[+/]", "x"), F.col("hex"),
                          F.upper(F.substring("hex", 1, 16)), shift=40))
    dotted = F.concat(F.lit("eyJ"), F.substring(url64, 1, 17), F.lit(".eyJ"), url64, F.lit("."),
                      F.substring(url64, 4, 40))
    random = pick(F.col("hex"), F.substring("b64", 1, 32), F.substring("hex", 1, 24), shift=21)
    short = pick(F.substring("b64", 1, 10), F.substring("b64", 3, 14), F.concat(
        F.substring("b64", 1, 5), pick("!", "#", "@$", "%", ".", shift=22),
        F.substring("b64", 7, 4), pick("", "!", "1", shift=23)), shift=24)
    words = F.concat(pick("example", "sample", "your", "static", shift=1),
                     pick("-", "_", "", "/", shift=2),
                     pick("version", "document", "module", "service", "content", shift=3),
                     pick("-", "_", "", shift=4),
                     pick("01", "2024", "7", "v2", "123456", "", shift=5))
    plain = F.concat(pick("thing", "ention", "There", "ation", "", shift=6),
                     pick("another", "erest", "Onthe", "intion", shift=7),
                     pick("heren", "stand", "ingly", "ofthe", "", shift=8),
                     pick("1", "22", "", "", shift=9))
    name = F.concat(pick("", "the ", "and ", "export ", "DB_", "https://example.com/cb?a=1&",
                         "my_", "in ", shift=10),
                    pick("token", "secret", "api_key", "password", "access_key", "auth_token",
                         "client secret", "AWS_SECRET_ACCESS_KEY", "apiKey", "access_token",
                         "PRIVATE_KEY", "passphrase", "passwort", "Kennwort", "contraseña",
                         "clave", "mot de passe", "jeton", shift=11),
                    pick(" = ", "=", "=", ": ", " := ", "\": ", shift=12))
    quote = pick("\"", "'", "", "", shift=13)
    end = pick("", " and", "&page=2", ",", shift=25)
    other = pick("commit ", "sha1 ", "checksum: ", "digest=", "build ", "version ", "image:",
                 "/static/", "https://example.com/", "src=\"/", "etag: \"", shift=14)
    field = F.concat(pick("id", "name", "path", "time", "date", "url", "title", "user", "page",
                          shift=26), pick("=", ": ", " = ", "=\"", shift=27))
    date = F.concat(pick("2024", "1999", shift=28), F.lit("-0"), pick("1", "7", shift=29),
                    F.lit("-12"), pick("", "T00", "T17", shift=30))
    prose = pick("the ", "use ", "of ", "", "Authorization: Bearer ", shift=31)
    lines = F.concat(F.substring(F.repeat("b64", 2), 1, 64), F.lit("\n"),
                     F.substring(F.repeat(F.concat(F.lit("Q9"), F.col("b64")), 2), 1, 64),
                     F.lit("\n"), F.substring("b64", 1, 22), F.lit("=="))
    kinds = [
        (random, F.concat(name, quote), F.concat(quote, end), 1),
        (short, F.concat(name, quote), F.concat(quote, end), 1),
        (pick(keyed, dotted, shift=32), F.concat(name, quote), F.concat(quote, end), 1),
        (keyed, prose, end, 1),
        (dotted, prose, end, 1),
        (pick(F.col("b64"), url64, shift=34), prose, end, 1),
        (random, other, pick("", ".png", ".js", " and", "/", shift=15), 0),
        (F.col("hex"), pick("of ", "the ", "", shift=35), end, 0),
        (short, pick("of ", "the ", "", field, shift=36), end, 0),
        (words, F.concat(name, quote), quote, 0),
        (F.when(F.col("id") % 2 == 0, words).otherwise(plain), other, F.lit(""), 0),
        (plain, name, end, 0),
        (pick(date, words, plain, F.col("hex"), shift=37), field, end, 0),
        (F.concat(F.lit("x1"), F.repeat(pick("0", "x", "ab", "A", "-", shift=16), 24)),
         F.concat(name, quote), quote, 0),
        (lines, pick("-----BEGIN PRIVATE KEY-----\n", "a -----BEGIN RSA PRIVATE KEY-----\n",
                     "key: -----BEGIN OPENSSH PRIVATE KEY-----\n", shift=38),
         F.lit("\n-----END"), 1),
        (lines, pick("-----BEGIN PUBLIC KEY-----\n", "-----BEGIN CERTIFICATE-----\n", shift=39),
         F.lit("\n-----END"), 0),
    ]
    parts = [hashed.select(F.concat(b, c, a).alias("text"), c.alias("value"),
                           F.lit(float(label)).alias("label")) for c, b, a, label in kinds]
    return reduce(DataFrame.unionByName, parts)


def labelled_findings(spark: SparkSession, rows: int = LABELLED_ROWS) -> DataFrame:
    """Findings with a known label: what the scanner takes out of labelled lines."""
    lines = labelled_lines(spark, rows)
    found = lines.select("value", "label", F.explode(_candidates(F.col("text"))).alias("f"))
    candidate = F.col("f.candidate")
    return found.select(
        candidate.alias("candidate"), "f.before", "f.after",
        F.when(F.contains("value", candidate) | F.contains(candidate, F.col("value")),
               F.col("label")).otherwise(0.0).alias("label"))


class Forest:
    """A trained forest as a column expression over an array of numbers."""

    def __init__(self, model: RandomForestClassificationModel):
        self._trees = [self._tree(t._java_obj.rootNode()) for t in model.trees]

    def _tree(self, node):
        if node.subtreeDepth() == 0:
            stats = list(node.impurityStats().stats())
            return float(stats[1] / sum(stats)) if sum(stats) else 0.5
        split = node.split()
        return (split.featureIndex(), float(split.threshold()),
                self._tree(node.leftChild()), self._tree(node.rightChild()))

    def score(self, features: Column) -> Column:
        def column(tree) -> Column:
            if not isinstance(tree, tuple):
                return F.lit(tree)
            i, threshold, left, right = tree
            return F.when(F.get(features, F.lit(i)) <= threshold, column(left)).otherwise(
                column(right))

        return reduce(add, [column(t) for t in self._trees]) / float(len(self._trees))


def train(labelled: DataFrame, trees: int = TREES, depth: int = DEPTH, seed: int = 3) -> Forest:
    """A forest for labelled findings, which are few: all of them are used."""
    rows = settle(labelled.select("label", array_to_vector(F.array(
        *_features(F.col("candidate"), F.col("before"), F.col("after")))).alias("features")),
        "findings")
    return Forest(RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed,
                                         featureSubsetStrategy="onethird").fit(rows))


def _candidates(text: Column) -> Column:
    """Array of word number, candidate, before and after."""
    words = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), _BLOCK, f"$1$2{_GLUE}"), _SPACE)

    def of_word(all_words: Column, i: Column) -> Column:
        word = F.get(all_words, i)
        previous = F.coalesce(F.get(all_words, i - 1), F.lit(""))
        # A value that follows its name and a space is taken like one without the space.
        glued = F.when(previous.rlike(r"[=:]>?$"), F.concat(F.lit("="), word)).otherwise(word)
        lead = F.array_join(F.transform(
            F.slice(all_words, F.greatest(i - 2, F.lit(0)) + 1, F.least(i, F.lit(2))),
            lambda w: F.substring(w, -CONTEXT, CONTEXT)), " ")

        def next_one(state: Column, c: Column) -> Column:
            at = F.call_function("locate", c, word, state["next"])
            return F.struct(
                (at + F.length(c)).alias("next"),
                F.concat(state["found"], F.array(F.struct(
                    i.alias("word_no"), F.replace(c, F.lit(_GLUE), F.lit("\n")).alias("candidate"),
                    F.concat(lead, F.lit(" "), F.substring(
                        word, F.greatest(at - CONTEXT, F.lit(1)),
                        F.least(at - 1, F.lit(CONTEXT)))).alias("before"),
                    F.coalesce(F.nullif(F.substring(word, at + F.length(c), F.lit(40)), F.lit("")),
                               F.concat(F.lit(" "), F.substring(F.get(all_words, i + 1), 1, 40)),
                               F.lit(""))
                    .alias("after")))).alias("found"))

        none = F.array().cast("array<struct<word_no:int,candidate:string,before:string,"
                              "after:string>>")
        return F.aggregate(
            # Words of letters alone match too, and only a named value may be one.
            F.filter(F.regexp_extract_all(glued, F.lit(_RUN), F.lit(0)),
                     lambda c: c.rlike("[0-9]") | glued.rlike("[=:]")),
            F.struct(F.lit(1).alias("next"), none.alias("found")), next_one)["found"]

    # An array of one element holds the words, which are split once.
    found = F.flatten(F.transform(F.array(words), lambda all_words: F.flatten(F.transform(
        F.filter(F.sequence(F.lit(0), F.size(all_words) - 1),
                 lambda i: F.length(F.get(all_words, i)) >= 6),
        lambda i: of_word(all_words, i)))))
    return F.filter(found, lambda x: (x["candidate"].rlike("[0-9]")
                                      & x["candidate"].rlike("[A-Za-z]"))
                    | (x["before"].rlike(_ASSIGNED) & _is_credential(x["before"])))


def with_findings(docs: DataFrame, forest: Forest, text: str = "text",
                  name: str = "findings") -> DataFrame:
    """``docs`` with an array of findings: word number, candidate, context, score."""
    measured = F.transform(_candidates(F.col(text)), lambda x: F.struct(
        x["word_no"].alias("word_no"), x["candidate"].alias("candidate"),
        x["before"].alias("before"), x["after"].alias("after"),
        F.array(*_features(x["candidate"], x["before"], x["after"])).alias("features")))
    judged = F.transform(measured, lambda x: F.struct(
        x["word_no"].alias("word_no"), x["candidate"].alias("candidate"),
        F.replace(x["before"], F.lit(_GLUE), F.lit("\n")).alias("before"),
        F.replace(x["after"], F.lit(_GLUE), F.lit("\n")).alias("after"),
        forest.score(x["features"]).alias("score")))
    # Most texts have no candidate at all and are not split.
    return docs.withColumn(name, F.when(F.col(text).rlike(_ANY), judged).otherwise(
        F.array().cast("array<struct<word_no:int,candidate:string,before:string,after:string,"
                       "score:double>>")))


def findings(docs: DataFrame, forest: Forest, doc_id: str = "doc_id", text: str = "text",
             threshold: float = THRESHOLD) -> DataFrame:
    """One row per finding, false ones included with their score."""
    found = with_findings(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")),
                          forest)
    return (found.select("doc_id", F.explode("findings").alias("f"))
            .select("doc_id", "f.*", (F.col("f.score") >= threshold).alias("is_secret")))


def masked(docs: DataFrame, forest: Forest, threshold: float = THRESHOLD,
           mask: str = MASK, text: str = "text", chars: str = "n_chars") -> DataFrame:
    """``docs`` with every secret replaced by ``mask``, in the same columns.

    A column ``chars``, if there is one, is the changed texts' new length. All other
    columns pass, whatever their names.
    """
    carried = Carried(docs)
    column = carried[text]
    found = with_findings(carried.rows, forest, column, "_findings")
    secrets = F.array_distinct(F.transform(
        F.filter("_findings", lambda x: x["score"] >= threshold), lambda x: x["candidate"]))
    # Longer ones first: one secret may be a part of another.
    secrets = F.reverse(F.array_sort(F.transform(secrets, lambda s: F.struct(
        F.length(s).alias("n"), s.alias("s")))))
    # Whole strings only: a short secret may also be a part of a word.
    put = F.lit(mask.replace("\\", "\\\\").replace("$", "\\$"))
    changed = F.aggregate(secrets, F.col(column), lambda t, s: F.regexp_replace(t, F.concat(
        F.lit(r"(?:(?<![A-Za-z0-9])|(?<=\\[nrt]))\Q"),
        F.replace(s["s"], F.lit("\n"), F.lit(rf"\E{_LINE_END}\Q")),
        F.lit(r"\E(?![A-Za-z0-9])")), put))
    out = found.withColumn(column, F.when(F.size("_findings") > 0, changed)
                           .otherwise(F.col(column)))
    if chars in carried.names:
        size = carried[chars]
        out = out.withColumn(size, F.when(
            F.size("_findings") > 0, F.length(column).cast(carried.rows.schema[size].dataType))
            .otherwise(F.col(size)))
    return carried.back(out)
