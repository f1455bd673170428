"""Licenses in text: ordered signature rules, gated by keywords, with containment suppression.

A rule is a pattern with a keyword, a label, a priority and a confidence; most come from a table of licenses in
four forms each (SPDX tag, grant, name, address), others stand alone. A text that holds none of the general words
runs no rule; a rule runs only on texts that hold its keyword. All matches of all rules become intervals, ordered by
start, longer first, then by priority. An interval inside one that was kept before is suppressed unless its
priority is higher; the others are kept. Everything is a Spark SQL expression; texts never leave their row.

The base looks for phrases as consecutive words, independent of the rules, and its labels always stay.

Defined results: a null or empty text has no words and no labels; texts are searched whole; places are word numbers
from 0; where two rules match the same interval with one priority, the first in the list gives the label.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwell.functions.sqltext import quote
from maskwell.llm.common import table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of a lower-cased text, and of a text as it is.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = (
    (("gnu", "general", "public", "license"), "gpl"),
    (("apache", "license"), "apache"),
    (("cc", "by"), "cc-by"),
    (("mit", "license"), "mit"),
)
#: One of these stands, in any case, in every text that a phrase or a rule can match;
GATE = (
    "licen", "copyright", "copyleft", "spdx", "public domain", "rights", "commons", "wtfpl", "gpl", "gnu.org",
    "apache.org", "mozilla", "permission", "redistribution", "proprietary", "what the", "zero", "cc0", "attribution",
    "unlicense", "wiki", "eclipse", "database", "spaces", "evil", "legal", "bsd", "vimhelp", "boost", "wtf", "sil.org",
    "eupl", "mariadb",
)
GATE_CC = r"(?i)cc[^0-9a-z\x{80}-\x{10FFFF}]+by"
NO_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
MARK, END, SPARE = "\x01", "\x03", "\x02"


@dataclass(frozen=True)
class Rule:
    label: str
    keyword: str
    pattern: str
    priority: int
    confidence: float


def licenses() -> tuple[tuple[str, str, str, str, str], ...]:
    """Label, keyword of the name, pattern of the name, SPDX identifier, pattern of the address; all lower case."""
    v = r"[,;]?\s*\(?(?:version\s*|v\.?\s*)?"
    gnu = r"(?:gnu\s+)?"
    cc = r"(?:creative\s+commons|cc)[\s-]+"
    return (
        ("gpl-1.0", "general public", rf"{gnu}general\s+public\s+licen[cs]e{v}1(?:\.0)?\b", r"gpl-1\.0", r"gnu\.org/licenses/old-licenses/gpl-1"),
        ("gpl-2.0", "general public", rf"{gnu}general\s+public\s+licen[cs]e{v}2(?:\.0)?\b", r"gpl-2\.0", r"gnu\.org/licenses/(?:old-licenses/)?gpl-2"),
        ("gpl-3.0", "general public", rf"{gnu}general\s+public\s+licen[cs]e{v}3(?:\.0)?\b", r"gpl-3\.0", r"gnu\.org/licenses/(?:gpl-3|gpl\.)"),
        ("lgpl-2.0", "general public", rf"{gnu}(?:library|lesser)\s+general\s+public\s+licen[cs]e{v}2(?:\.0)?\b", r"lgpl-2\.0", r"gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.0"),
        ("lgpl-2.1", "lesser general", rf"{gnu}lesser\s+general\s+public\s+licen[cs]e{v}2\.1\b", r"lgpl-2\.1", r"gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1"),
        ("lgpl-3.0", "lesser general", rf"{gnu}lesser\s+general\s+public\s+licen[cs]e{v}3(?:\.0)?\b", r"lgpl-3\.0", r"gnu\.org/licenses/lgpl-3"),
        ("agpl-3.0", "affero", rf"{gnu}affero\s+general\s+public\s+licen[cs]e{v}3(?:\.0)?\b", r"agpl-3\.0", r"gnu\.org/licenses/agpl"),
        ("gfdl-1.3", "free documentation", rf"{gnu}free\s+documentation\s+licen[cs]e(?:{v}1\.[123]\b)?", r"gfdl-1\.[123]", r"gnu\.org/licenses/fdl"),
        ("apache-1.1", "apache", rf"apache\s+(?:software\s+)?licen[cs]e{v}1\.1\b", r"apache-1\.1", r"apache\.org/licenses/license-1\.1"),
        ("apache-2.0", "apache", rf"apache\s+(?:software\s+)?licen[cs]e{v}2(?:\.0)?\b", r"apache-2\.0", r"apache\.org/licenses/license-2"),
        ("mit", "mit", r"\bmit\s+licen[cs]e\b", r"mit", r"opensource\.org/licenses?/mit\b"),
        ("mit-0", "mit no attribution", r"\bmit\s+no\s+attribution\b", r"mit-0", r"opensource\.org/licenses?/mit-0"),
        ("bsd-2-clause", "bsd", r"(?:simplified|2-clause|two-clause)\s+bsd\s+licen[cs]e|\bbsd\s+2-clause(?:\s+licen[cs]e)?", r"bsd-2-clause", r"opensource\.org/licenses?/bsd-2"),
        ("bsd-3-clause", "bsd", r"(?:new|modified|revised|3-clause|three-clause)\s+bsd\s+licen[cs]e|\bbsd\s+3-clause(?:\s+licen[cs]e)?", r"bsd-3-clause", r"opensource\.org/licenses?/bsd-3"),
        ("bsd-4-clause", "bsd", r"(?:original|4-clause|four-clause)\s+bsd\s+licen[cs]e|\bbsd\s+4-clause", r"bsd-4-clause", r"directory\.fsf\.org/wiki/license:bsd-4"),
        ("isc", "isc", r"\bisc\s+licen[cs]e\b", r"isc", r"opensource\.org/licenses?/isc"),
        ("zlib", "zlib", r"\bzlib(?:/libpng)?\s+licen[cs]e\b", r"zlib", r"opensource\.org/licenses?/zlib"),
        ("mpl-1.1", "mozilla", rf"mozilla\s+public\s+licen[cs]e{v}1\.1\b", r"mpl-1\.1", r"mozilla\.org/mpl/(?:mpl-)?1\.1"),
        ("mpl-2.0", "mozilla", rf"mozilla\s+public\s+licen[cs]e{v}2(?:\.0)?\b", r"mpl-2\.0", r"mozilla\.org/(?:en-us/)?mpl/2"),
        ("epl-1.0", "eclipse", rf"eclipse\s+public\s+licen[cs]e{v}1(?:\.0)?\b", r"epl-1\.0", r"eclipse\.org/legal/epl-v10"),
        ("epl-2.0", "eclipse", rf"eclipse\s+public\s+licen[cs]e{v}2(?:\.0)?\b", r"epl-2\.0", r"eclipse\.org/legal/epl-(?:v20|2)"),
        ("cddl-1.0", "common development", rf"common\s+development\s+and\s+distribution\s+licen[cs]e(?:{v}1(?:\.0)?\b)?", r"cddl-1\.0", r"opensource\.org/licenses?/cddl"),
        ("cpl-1.0", "common public", rf"common\s+public\s+licen[cs]e(?:{v}1(?:\.0)?\b)?", r"cpl-1\.0", r"opensource\.org/licenses?/cpl"),
        ("eupl-1.1", "european union public", rf"european\s+union\s+public\s+licen[cs]e{v}1\.1\b", r"eupl-1\.1", r"joinup\.ec\.europa\.eu/software/page/eupl"),
        ("eupl-1.2", "european union public", rf"european\s+union\s+public\s+licen[cs]e{v}1\.2\b", r"eupl-1\.2", r"eupl\.eu/1\.2"),
        ("osl-3.0", "open software", rf"open\s+software\s+licen[cs]e{v}3(?:\.0)?\b", r"osl-3\.0", r"opensource\.org/licenses?/osl-3"),
        ("afl-3.0", "academic free", rf"academic\s+free\s+licen[cs]e(?:{v}3(?:\.0)?\b)?", r"afl-3\.0", r"opensource\.org/licenses?/afl"),
        ("artistic-1.0", "artistic", rf"artistic\s+licen[cs]e{v}1(?:\.0)?\b", r"artistic-1\.0", r"opensource\.org/licenses?/artistic-1"),
        ("artistic-2.0", "artistic", rf"artistic\s+licen[cs]e{v}2(?:\.0)?\b", r"artistic-2\.0", r"opensource\.org/licenses?/artistic-2"),
        ("bsl-1.0", "boost", rf"boost\s+software\s+licen[cs]e(?:{v}1(?:\.0)?\b)?", r"bsl-1\.0", r"boost\.org/license_1_0"),
        ("busl-1.1", "business source", rf"business\s+source\s+licen[cs]e(?:{v}1\.1\b)?", r"busl-1\.1", r"mariadb\.com/bsl11"),
        ("sspl-1.0", "server side", rf"server\s+side\s+public\s+licen[cs]e(?:{v}1(?:\.0)?\b)?", r"sspl-1\.0", r"mongodb\.com/licensing/server-side"),
        ("elastic-2.0", "elastic", rf"elastic\s+licen[cs]e(?:{v}2(?:\.0)?\b)?", r"elastic-2\.0", r"elastic\.co/licensing/elastic-license"),
        ("unlicense", "unlicense", r"\bthe\s+unlicense\b", r"unlicense", r"unlicense\.org"),
        ("wtfpl", "what the", r"do\s+what\s+the\s+f\S*\s+you\s+want\s+to\s+public\s+licen[cs]e", r"wtfpl", r"wtfpl\.net"),
        ("cc0-1.0", "cc0|zero", rf"(?:{cc})?(?:cc0|zero)[\s-]+(?:universal|1\.0)(?:\s+universal)?", r"cc0-1\.0", r"creativecommons\.org/publicdomain/zero"),
        ("cc-by-1.0", "cc|commons", rf"{cc}(?:by|attribution)[\s-]+1\.0\b", r"cc-by-1\.0", r"creativecommons\.org/licenses/by/1"),
        ("cc-by-2.0", "cc|commons", rf"{cc}(?:by|attribution)[\s-]+2\.0\b", r"cc-by-2\.0", r"creativecommons\.org/licenses/by/2"),
        ("cc-by-3.0", "cc|commons", rf"{cc}(?:by|attribution)[\s-]+3\.0\b", r"cc-by-3\.0", r"creativecommons\.org/licenses/by/3"),
        ("cc-by-4.0", "cc|commons", rf"{cc}by[\s-]+4\.0\b|{cc}attribution[\s-]+4\.0\b", r"cc-by-4\.0", r"creativecommons\.org/licenses/by/4"),
        ("cc-by-sa-3.0", "cc|commons", rf"{cc}by[\s-]+sa[\s-]+3\.0\b", r"cc-by-sa-3\.0", r"creativecommons\.org/licenses/by-sa/3"),
        ("cc-by-sa-4.0", "cc|commons", rf"{cc}by[\s-]+sa[\s-]+4\.0\b", r"cc-by-sa-4\.0", r"creativecommons\.org/licenses/by-sa/4"),
        ("cc-by-nd-4.0", "cc|commons", rf"{cc}by[\s-]+nd[\s-]+4\.0\b", r"cc-by-nd-4\.0", r"creativecommons\.org/licenses/by-nd/4"),
        ("cc-by-nc-3.0", "cc|commons", rf"{cc}by[\s-]+nc[\s-]+3\.0\b", r"cc-by-nc-3\.0", r"creativecommons\.org/licenses/by-nc/3"),
        ("cc-by-nc-4.0", "cc|commons", rf"{cc}by[\s-]+nc[\s-]+4\.0\b", r"cc-by-nc-4\.0", r"creativecommons\.org/licenses/by-nc/4"),
        ("cc-by-nc-sa-4.0", "cc|commons", rf"{cc}by[\s-]+nc[\s-]+sa[\s-]+4\.0\b", r"cc-by-nc-sa-4\.0", r"creativecommons\.org/licenses/by-nc-sa/4"),
        ("cc-by-nc-nd-4.0", "cc|commons", rf"{cc}by[\s-]+nc[\s-]+nd[\s-]+4\.0\b", r"cc-by-nc-nd-4\.0", r"creativecommons\.org/licenses/by-nc-nd/4"),
        ("odbl-1.0", "open database|open data commons", rf"open\s+database\s+licen[cs]e(?:{v}1(?:\.0)?\b)?|open\s+data\s+commons\s+open\s+database", r"odbl-1\.0", r"opendatacommons\.org/licenses/odbl"),
        ("odc-by-1.0", "open data commons", r"open\s+data\s+commons\s+attribution\s+licen[cs]e", r"odc-by-1\.0", r"opendatacommons\.org/licenses/by"),
        ("pddl-1.0", "public domain dedication", r"public\s+domain\s+dedication\s+(?:and|&)\s+licen[cs]e", r"pddl-1\.0", r"opendatacommons\.org/licenses/pddl"),
        ("ofl-1.1", "open font", rf"(?:sil\s+)?open\s+font\s+licen[cs]e(?:{v}1\.1\b)?", r"ofl-1\.1", r"scripts\.sil\.org/ofl"),
        ("psf-2.0", "python software", r"python\s+software\s+foundation\s+licen[cs]e", r"psf-2\.0", r"docs\.python\.org/3/license"),
        ("php-3.01", "php", rf"php\s+licen[cs]e(?:{v}3\.01\b)?", r"php-3\.01", r"php\.net/license"),
        ("ruby", "ruby", r"\bruby\s+licen[cs]e\b", r"ruby", r"ruby-lang\.org/en/about/license"),
        ("postgresql", "postgresql", r"postgresql\s+licen[cs]e", r"postgresql", r"postgresql\.org/about/licence"),
        ("openssl", "openssl", r"openssl\s+licen[cs]e", r"openssl", r"openssl\.org/source/license"),
        ("upl-1.0", "universal permissive", rf"universal\s+permissive\s+licen[cs]e(?:{v}1(?:\.0)?\b)?", r"upl-1\.0", r"opensource\.org/licenses?/upl"),
        ("ncsa", "ncsa", r"(?:university\s+of\s+illinois/)?ncsa\s+open\s+source\s+licen[cs]e", r"ncsa", r"opensource\.org/licenses?/ncsa"),
        ("ms-pl", "microsoft public", r"microsoft\s+public\s+licen[cs]e", r"ms-pl", r"opensource\.org/licenses?/ms-pl"),
        ("ms-rl", "microsoft reciprocal", r"microsoft\s+reciprocal\s+licen[cs]e", r"ms-rl", r"opensource\.org/licenses?/ms-rl"),
        ("vim", "vim", r"\bvim\s+licen[cs]e\b", r"vim", r"vimhelp\.org/uganda"),
        ("json", "json|not evil", r"\bjson\s+licen[cs]e\b|shall\s+be\s+used\s+for\s+good,?\s+not\s+evil", r"json", r"json\.org/license"),
        ("openrail", "rail", r"(?:creativeml\s+)?open\s*rail(?:\+\+)?(?:-m)?\s+licen[cs]e", r"openrail(?:-m)?", r"huggingface\.co/spaces/\S+/license"),
    )


def rules() -> list[Rule]:
    """All rules in order: tags, grants, names, addresses, then those without a version and notices."""
    out: list[Rule] = []
    rows = licenses()
    grant = r"(?:licen[cs]ed|released|distributed|published|available|redistribut\w+)\s+under\s+(?:the\s+)?(?:terms\s+(?:and\s+conditions\s+)?of\s+(?:the\s+)?)?"
    tail = r"(?![a-z0-9.-]*[a-z0-9])"
    out += [Rule(n, "spdx-license", rf"spdx-license-identifier:[ \t(]*{spdx}(?:-only|-or-later)?\+?{tail}", 4, 1.0) for n, _, _, spdx, _ in rows]
    out += [Rule(n, word, rf"{grant}(?:{name})", 3, 0.95) for n, word, name, _, _ in rows]
    out += [Rule(n, word, name, 2, 0.85) for n, word, name, _, _ in rows]
    out += [Rule(n, re.split(r"\\|\(|/|-", url)[0], url, 2, 0.9) for n, _, _, _, url in rows]
    plain = (
        ("gpl", "general public", r"(?:gnu\s+)?general\s+public\s+licen[cs]e", 1, 0.7),
        ("lgpl", "lesser general", r"(?:gnu\s+)?lesser\s+general\s+public\s+licen[cs]e", 1, 0.7),
        ("agpl", "affero", r"(?:gnu\s+)?affero\s+general\s+public\s+licen[cs]e", 1, 0.7),
        ("gpl", "gpl", r"\bgpl(?:v[123](?:\.0)?\+?)?\b", 1, 0.5),
        ("lgpl", "lgpl", r"\blgpl(?:v[23](?:\.[01])?\+?)?\b", 1, 0.5),
        ("agpl", "agpl", r"\bagpl(?:v3)?\b", 1, 0.5),
        ("apache", "apache", r"apache\s+(?:software\s+)?licen[cs]e", 1, 0.7),
        ("bsd", "bsd", r"\bbsd(?:-style)?\s+licen[cs]e", 1, 0.7),
        ("bsd", "redistribution and use", r"redistribution\s+and\s+use\s+in\s+source\s+and\s+binary\s+forms", 1, 0.8),
        ("mit", "permission is hereby", r"permission\s+is\s+hereby\s+granted,?\s+free\s+of\s+charge,?\s+to\s+any\s+person\s+obtaining\s+a\s+copy", 1, 0.8),
        ("isc", "permission to use", r"permission\s+to\s+use,?\s+copy,?\s+modify,?\s+and(?:/or)?\s+distribute\s+this\s+software", 1, 0.7),
        ("mpl", "mozilla", r"mozilla\s+public\s+licen[cs]e", 1, 0.7),
        ("epl", "eclipse", r"eclipse\s+public\s+licen[cs]e", 1, 0.7),
        ("artistic", "artistic", r"artistic\s+licen[cs]e", 1, 0.6),
        ("cc-by-sa", "cc", r"\bcc[\s-]+by[\s-]+sa\b", 1, 0.7),
        ("cc-by-nd", "cc", r"\bcc[\s-]+by[\s-]+nd\b", 1, 0.7),
        ("cc-by-nc", "cc", r"\bcc[\s-]+by[\s-]+nc\b", 1, 0.7),
        ("cc-by-nc-sa", "cc", r"\bcc[\s-]+by[\s-]+nc[\s-]+sa\b", 1, 0.7),
        ("cc-by-nc-nd", "cc", r"\bcc[\s-]+by[\s-]+nc[\s-]+nd\b", 1, 0.7),
        ("cc0", "cc0", r"\bcc0\b", 1, 0.6),
        ("creative-commons", "creative", r"creative\s+commons", 0, 0.5),
        ("public-domain", "public domain", r"(?:released|dedicated|placed)\s+(?:in)?to\s+the\s+public\s+domain|(?:is|are)\s+in\s+the\s+public\s+domain", 1, 0.7),
        ("proprietary", "all rights reserved", r"all\s+rights\s+reserved", 0, 0.4),
        ("proprietary", "proprietary", r"proprietary\s+(?:and\s+confidential|licen[cs]e)", 1, 0.6),
        ("proprietary", "end user", r"end\s+user\s+licen[cs]e\s+agreement", 1, 0.6),
        ("copyleft", "copyleft", r"\bcopyleft\b", 0, 0.4),
        ("copyright", "copyright", r"copyright\s+(?:\(c\)|©)?\s*(?:19|20)\d\d", 0, 0.3),
        ("licensed", "licen", r"\blicen[cs]ed\s+under\b", 0, 0.3),
    )
    return out + [Rule(*row) for row in plain]


def matches_of(column: str, which: list[Rule]) -> Column:
    """Rules with matches in a lower-cased column without marks: array of (rule, parts).

    The text is cut before every match; all parts but the first begin with a match and its end mark. Rules
    are grouped by keyword, so that a text without it passes all of them with one test.
    """
    groups: dict[str, list[int]] = {}
    for i, rule in enumerate(which):
        groups.setdefault(rule.keyword, []).append(i)
    parts = []
    for keyword, own in groups.items():
        runs = ", ".join(
            f"named_struct('rule', {i}, 'parts', split(regexp_replace({column}, {quote(which[i].pattern)}, "
            f"'{MARK}$0{END}'), '{MARK}', -1))"
            for i in own
        )
        tests = " OR ".join(f"contains({column}, {quote(word)})" for word in keyword.split("|"))
        parts.append(f"CASE WHEN {tests} THEN filter(array({runs}), r -> size(r.parts) > 1) END")
    return F.expr(f"flatten(filter(array({', '.join(parts)}), g -> g IS NOT NULL))")


def intervals(runs: Column, which: list[Rule]) -> Column:
    """(start, minus end, minus priority, rule) of every match, in the order in which they are judged."""
    priority = F.array(*[F.lit(-r.priority) for r in which])

    def walk(run: Column) -> Column:
        none = F.array().cast("array<struct<start:int,end:int,priority:int,rule:int>>")
        begin = F.struct(F.lit(0).alias("at"), none.alias("out"))

        def step(acc: Column, part: Column) -> Column:
            size = F.instr(part, END) - 1
            one = F.struct(
                acc["at"].alias("start"),
                (-(acc["at"] + size)).alias("end"),
                F.get(priority, run["rule"]).alias("priority"),
                run["rule"].alias("rule"),
            )
            return F.struct(
                (acc["at"] + F.length(part) - F.when(size >= 0, 1).otherwise(0)).alias("at"),
                F.when(size >= 0, F.concat(acc["out"], F.array(one))).otherwise(acc["out"]).alias("out"),
            )

        return F.aggregate(run["parts"], begin, step, lambda acc: acc["out"])

    return F.array_sort(F.flatten(F.transform(runs, walk)))


def kept_rules(spans: Column) -> Column:
    """The rules whose intervals are kept; `spans` in the order of `intervals`."""
    begin = F.struct(
        F.lit(-1).alias("end"), F.lit(99).alias("priority"), F.array().cast("array<int>").alias("out")
    )

    def step(acc: Column, s: Column) -> Column:
        beyond = -s["end"] > acc["end"]
        keep = beyond | (-s["priority"] > acc["priority"])
        return F.when(
            keep,
            F.struct(
                F.greatest(-s["end"], acc["end"]).alias("end"),
                F.when(beyond, -s["priority"]).otherwise(F.greatest(-s["priority"], acc["priority"])).alias("priority"),
                F.array_union(acc["out"], F.array(s["rule"])).alias("out"),
            ),
        ).otherwise(acc)

    return F.aggregate(spans, begin, step, lambda acc: acc["out"])


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every row of `docs`."""
    which = rules()
    text = F.coalesce("text", F.lit("").cast("string"))
    rows = docs.select("doc_id", text.alias("text"), F.lower(text).alias("any_case"))
    open_ = reduce(or_, [F.contains("any_case", F.lit(word)) for word in GATE])
    open_ = open_ | (F.contains("any_case", F.lit("cc")) & F.col("text").rlike(GATE_CC))
    edges = F.substring("text", 1, 1).rlike(NO_WORD).cast("int") + F.right("text", F.lit(1)).rlike(NO_WORD).cast("int")
    n_words = F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", NO_WORD + "+", -1)) - edges)
    low = F.when(open_, F.translate("text", UPPER + MARK + END, LOWER + SPARE + SPARE))
    # Each word between two blanks of its own, so that neighbouring phrases share none.
    spaced = F.concat(F.lit(" "), F.array_join(F.regexp_extract_all("low", F.lit(WORD), F.lit(0)), "  "), F.lit(" "))
    rows = rows.select("doc_id", n_words.cast("long").alias("n_words"), low.alias("low"))
    rows = rows.select("doc_id", "n_words", spaced.alias("spaced"), matches_of("low", which).alias("runs"))

    def words_in(part: Column) -> Column:
        blanks = F.length(part) - F.length(F.replace(part, F.lit(" "), F.lit("")))
        return (blanks / 2).cast("long")

    count, first, last, labels = F.lit(0).cast("long"), [], [], []
    for words, label in PHRASES:
        phrase = " " + "  ".join(words) + " "
        n = F.coalesce(
            (F.length("spaced") - F.length(F.replace("spaced", F.lit(phrase), F.lit("")))) / F.lit(len(phrase)), F.lit(0)
        ).cast("long")
        count = count + n
        first.append(F.when(n > 0, words_in(F.substring_index("spaced", phrase, 1))))
        last.append(F.when(n > 0, F.col("n_words") - words_in(F.substring_index("spaced", phrase, -1)) - len(words)))
        labels.append(F.when(n > 0, F.lit(label)))
    base = F.filter(F.array(*labels), lambda x: x.isNotNull())
    rows = rows.select(
        "doc_id",
        "n_words",
        count.alias("n_base"),
        F.least(*first).alias("first_word"),
        F.greatest(*last).alias("last_word"),
        F.coalesce(base, F.array().cast("array<string>")).alias("base"),
        F.coalesce(kept_rules(intervals(F.col("runs"), which)), F.array().cast("array<int>")).alias("kept"),
    )
    names = F.array(*[F.lit(r.label) for r in which])
    trust = F.array(*[F.lit(r.confidence) for r in which])
    own = F.transform("kept", lambda i: F.get(names, i))
    best = F.array_max(F.transform("kept", lambda i: F.get(trust, i)))
    return rows.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", own)), ",").alias("labels"),
        F.coalesce(F.greatest(best, F.when(F.col("n_base") > 0, F.lit(0.6))), F.lit(0.0)).alias("score"),
    )


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
