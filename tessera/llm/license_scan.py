"""License scans by ordered signature rules.

Every license has a hand-written name pattern; four templates (SPDX tag, grant, web address, bare
name) make its rules, and sentences of license texts make some more, a few hundred in all, each with a keyword
without which it cannot match. An SPDX tag may hold an expression (AND, OR, WITH, brackets); each license in
it is found, and tags don't suppress each other. A
text is first searched for a few short strings of which every rule needs one, then for each rule's
keyword, and only rules whose keyword occurs are run. Keywords see white space and hyphens as one space. Their hits are intervals of code points. A hit that lies within
another of the same or a better priority is suppressed; rules that name no license count only
where nothing else is left. All of it is one map over rows, in Spark's own functions.

Besides the rules, three phrases of plain words are counted wherever they stand (``n_base``). Words
are runs of ASCII letters or digits and of characters beyond ASCII.

A null text counts as empty: no words, no labels, score 0. Rows are independent, so repeated rows
get equal answers; columns of docs are passed on, and their own columns of the result's names are
replaced. score is the weight of the best template that is left (name 0.7 to SPDX tag 1.0), 0.5 for
a phrase or a general notice alone, and 0 without any.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

# Label, keyword, name pattern, SPDX identifiers, web address.
LICENSES = [
    ("mit", "mit licen", r"MIT\s+licen[cs]e", "MIT", r"opensource\.org/licenses?/mit"),
    ("mit", "expat", r"(?:MIT\s+\(Expat\)|Expat)\s+licen[cs]e", "Expat", r"jclark\.com/xml/copying"),
    ("mit-0", "no attribution", r"MIT\s+No\s+Attribution", "MIT-0", r"opensource\.org/licenses?/mit-0"),
    ("apache-1.1", "apache", r"Apache\s+(?:Software\s+)?licen[cs]e,?\s+(?:version\s+)?v?1\.1", "Apache-1.1", r"apache\.org/licenses/LICENSE-1\.1"),
    ("apache-2.0", "apache", r"Apache\s+(?:Software\s+)?licen[cs]e,?\s+(?:version\s+)?v?2(?:\.0)?", "Apache-2.0", r"apache\.org/licenses/LICENSE-2\.0"),
    ("apache", "apache", r"Apache\s+(?:Software\s+)?licen[cs]e", "Apache", r"apache\.org/licenses"),
    ("gpl-1.0", "general public", r"(?:GNU\s+)?General\s+Public\s+licen[cs]e,?\s+(?:version|v)\.?\s*1(?:\.0)?\b", "GPL-1.0(?:-only|-or-later|\\+)?", r"gnu\.org/licenses/(?:old-licenses/)?gpl-1"),
    ("gpl-2.0", "general public", r"(?:GNU\s+)?General\s+Public\s+licen[cs]e,?\s+(?:version|v)\.?\s*2(?:\.0)?\b", "GPL-2.0(?:-only|-or-later|\\+)?", r"gnu\.org/licenses/(?:old-licenses/)?gpl-2"),
    ("gpl-3.0", "general public", r"(?:GNU\s+)?General\s+Public\s+licen[cs]e,?\s+(?:version|v)\.?\s*3(?:\.0)?\b", "GPL-3.0(?:-only|-or-later|\\+)?", r"gnu\.org/licenses/gpl-3"),
    ("gpl", "general public", r"(?:GNU\s+)?General\s+Public\s+licen[cs]e", "GPL", r"gnu\.org/licenses/gpl"),
    ("lgpl-2.1", "general public", r"(?:GNU\s+)?(?:Lesser|Library)\s+General\s+Public\s+licen[cs]e,?\s+(?:version|v)\.?\s*2(?:\.[01])?\b", "LGPL-2.[01](?:-only|-or-later|\\+)?", r"gnu\.org/licenses/(?:old-licenses/)?lgpl-2"),
    ("lgpl-3.0", "lesser general", r"(?:GNU\s+)?Lesser\s+General\s+Public\s+licen[cs]e,?\s+(?:version|v)\.?\s*3(?:\.0)?\b", "LGPL-3.0(?:-only|-or-later|\\+)?", r"gnu\.org/licenses/lgpl-3"),
    ("lgpl", "lesser general", r"(?:GNU\s+)?Lesser\s+General\s+Public\s+licen[cs]e", "LGPL", r"gnu\.org/licenses/lgpl"),
    ("agpl-3.0", "affero", r"(?:GNU\s+)?Affero\s+General\s+Public\s+licen[cs]e(?:,?\s+(?:version|v)\.?\s*3(?:\.0)?)?", "AGPL-3.0(?:-only|-or-later|\\+)?", r"gnu\.org/licenses/agpl"),
    ("gfdl", "documentation licen", r"(?:GNU\s+)?Free\s+Documentation\s+licen[cs]e", "GFDL-1.[123](?:-only|-or-later)?", r"gnu\.org/licenses/fdl"),
    ("bsd-2-clause", "bsd", r"(?:2-clause|two[ -]clause|simplified|FreeBSD)\s+BSD(?:\s+licen[cs]e)?|BSD\s+2-clause(?:\s+licen[cs]e)?", "BSD-2-Clause", r"opensource\.org/licenses?/bsd-2-clause"),
    ("bsd-3-clause", "bsd", r"(?:3-clause|three[ -]clause|new|modified|revised)\s+BSD(?:\s+licen[cs]e)?|BSD\s+3-clause(?:\s+licen[cs]e)?", "BSD-3-Clause", r"opensource\.org/licenses?/bsd-3-clause"),
    ("bsd-4-clause", "bsd", r"(?:4-clause|four[ -]clause|original|old)\s+BSD(?:\s+licen[cs]e)?|BSD\s+4-clause(?:\s+licen[cs]e)?", "BSD-4-Clause", r"spdx\.org/licenses/BSD-4"),
    ("0bsd", "bsd", r"(?:zero[ -]clause|0-clause)\s+BSD(?:\s+licen[cs]e)?|BSD\s+zero[ -]clause", "0BSD", r"opensource\.org/licenses?/0bsd"),
    ("bsd", "bsd", r"BSD(?:-style)?\s+licen[cs]e", "BSD", r"opensource\.org/licenses?/bsd"),
    ("isc", "isc licen", r"ISC\s+licen[cs]e", "ISC", r"opensource\.org/licenses?/isc"),
    ("mpl-1.1", "mozilla", r"Mozilla\s+Public\s+licen[cs]e,?\s+(?:version\s+|v\.?\s*)?1\.[01]", "MPL-1.[01]", r"mozilla\.org/MPL/1"),
    ("mpl-2.0", "mozilla", r"Mozilla\s+Public\s+licen[cs]e,?\s+(?:version\s+|v\.?\s*)?2\.0", "MPL-2.0", r"mozilla\.org/(?:en-US/)?MPL/2"),
    ("mpl", "mozilla", r"Mozilla\s+Public\s+licen[cs]e", "MPL", r"mozilla\.org/MPL"),
    ("epl-1.0", "eclipse", r"Eclipse\s+Public\s+licen[cs]e(?:\s*-)?,?\s+(?:version\s+|v\.?\s*)?1\.0", "EPL-1.0", r"eclipse\.org/legal/epl-v10"),
    ("epl-2.0", "eclipse", r"Eclipse\s+Public\s+licen[cs]e(?:\s*-)?,?\s+(?:version\s+|v\.?\s*)?2\.0", "EPL-2.0", r"eclipse\.org/legal/epl-2"),
    ("edl-1.0", "eclipse", r"Eclipse\s+Distribution\s+licen[cs]e", "EDL-1.0", r"eclipse\.org/org/documents/edl"),
    ("cddl-1.0", "common development", r"Common\s+Development\s+and\s+Distribution\s+licen[cs]e", "CDDL-1.[01]", r"opensource\.org/licenses?/cddl"),
    ("cpl-1.0", "common public", r"Common\s+Public\s+licen[cs]e", "CPL-1.0", r"opensource\.org/licenses?/cpl"),
    ("ipl-1.0", "ibm public", r"IBM\s+Public\s+licen[cs]e", "IPL-1.0", r"opensource\.org/licenses?/ibmpl"),
    ("artistic-1.0", "artistic", r"Artistic\s+licen[cs]e,?\s+(?:version\s+|v\.?\s*)?1\.0", "Artistic-1.0(?:-Perl)?", r"opensource\.org/licenses?/artistic-1"),
    ("artistic-2.0", "artistic", r"Artistic\s+licen[cs]e,?\s+(?:version\s+|v\.?\s*)?2\.0", "Artistic-2.0", r"opensource\.org/licenses?/artistic-2"),
    ("artistic", "artistic", r"Artistic\s+licen[cs]e", "Artistic", r"perlfoundation\.org/artistic"),
    ("bsl-1.0", "boost", r"Boost\s+Software\s+licen[cs]e", "BSL-1.0", r"boost\.org/LICENSE"),
    ("busl-1.1", "business source", r"Business\s+Source\s+licen[cs]e", "BUSL-1.1", r"mariadb\.com/bsl"),
    ("unlicense", "unlicense", r"The\s+Unlicense|Unlicense", "Unlicense", r"unlicense\.org"),
    ("wtfpl", "public licen", r"Do\s+What\s+The\s+F\w*\s+You\s+Want\s+To\s+Public\s+licen[cs]e", "WTFPL", r"wtfpl\.net"),
    ("wtfpl", "wtfpl", r"WTFPL", "WTFPL", r"wtfpl\.net"),
    ("zlib", "zlib", r"zlib(?:/libpng)?\s+licen[cs]e", "Zlib", r"opensource\.org/licenses?/zlib"),
    ("libpng", "libpng", r"libpng\s+licen[cs]e", "Libpng", r"libpng\.org/pub/png/src/libpng-LICENSE"),
    ("openssl", "openssl", r"OpenSSL\s+licen[cs]e", "OpenSSL", r"openssl\.org/source/license"),
    ("php-3.01", "php licen", r"PHP\s+licen[cs]e", "PHP-3.01?", r"php\.net/license"),
    ("psf-2.0", "python", r"Python\s+(?:Software\s+Foundation\s+)?licen[cs]e", "(?:PSF|Python)-2.0", r"python\.org/psf/license"),
    ("ruby", "ruby licen", r"Ruby\s+licen[cs]e", "Ruby", r"ruby-lang\.org/[a-z]*/?about/license"),
    ("postgresql", "postgresql", r"PostgreSQL\s+licen[cs]e", "PostgreSQL", r"postgresql\.org/about/licence"),
    ("x11", "x11", r"X11\s+licen[cs]e", "X11", r"xfree86\.org/.{0,20}LICENSE"),
    ("ncsa", "ncsa", r"(?:University\s+of\s+Illinois/)?NCSA\s+(?:open\s+source\s+)?licen[cs]e", "NCSA", r"opensource\.org/licenses?/ncsa"),
    ("afl-3.0", "academic free", r"Academic\s+Free\s+licen[cs]e", "AFL-[123].[0-2]", r"opensource\.org/licenses?/afl"),
    ("osl-3.0", "open software", r"Open\s+Software\s+licen[cs]e", "OSL-[123].[01]", r"opensource\.org/licenses?/osl"),
    ("eupl-1.2", "european union public", r"European\s+Union\s+Public\s+licen[cs]e", "EUPL-1.[012]", r"joinup\.ec\.europa\.eu/.{0,40}eupl"),
    ("ecl-2.0", "educational community", r"Educational\s+Community\s+licen[cs]e", "ECL-[12].0", r"opensource\.org/licenses?/ecl"),
    ("ms-pl", "microsoft public", r"Microsoft\s+Public\s+licen[cs]e", "MS-PL", r"opensource\.org/licenses?/ms-pl"),
    ("ms-rl", "microsoft reciprocal", r"Microsoft\s+Reciprocal\s+licen[cs]e", "MS-RL", r"opensource\.org/licenses?/ms-rl"),
    ("ofl-1.1", "open font", r"(?:SIL\s+)?Open\s+Font\s+licen[cs]e", "OFL-1.[01]", r"scripts\.sil\.org/OFL"),
    ("odbl-1.0", "open database", r"Open\s+(?:Data\s+Commons\s+Open\s+)?Database\s+licen[cs]e", "ODbL-1.0", r"opendatacommons\.org/licenses/odbl"),
    ("pddl-1.0", "public domain dedication", r"Public\s+Domain\s+Dedication\s+and\s+licen[cs]e", "PDDL-1.0", r"opendatacommons\.org/licenses/pddl"),
    ("cc0-1.0", "cc0", r"CC0(?:\s+1\.0)?(?:\s+Universal)?", "CC0-1.0", r"creativecommons\.org/publicdomain/zero"),
    ("cc-by-nc-nd-4.0", "cc by nc nd", r"CC[ -]BY-NC-ND(?:[ -][1-4]\.0)?", "CC-BY-NC-ND-[1-4].0", r"creativecommons\.org/licenses/by-nc-nd"),
    ("cc-by-nc-nd-4.0", "creative commons", r"Creative\s+Commons\s+Attribution-Non-?Commercial-No-?Deriv\w*", "CC-BY-NC-ND-[1-4].0", r"creativecommons\.org/licenses/by-nc-nd"),
    ("cc-by-nc-sa-4.0", "cc by nc sa", r"CC[ -]BY-NC-SA(?:[ -][1-4]\.0)?", "CC-BY-NC-SA-[1-4].0", r"creativecommons\.org/licenses/by-nc-sa"),
    ("cc-by-nc-sa-4.0", "creative commons", r"Creative\s+Commons\s+Attribution-Non-?Commercial-Share-?Alike", "CC-BY-NC-SA-[1-4].0", r"creativecommons\.org/licenses/by-nc-sa"),
    ("cc-by-nc-4.0", "cc by nc", r"CC[ -]BY-NC(?:[ -][1-4]\.0)?", "CC-BY-NC-[1-4].0", r"creativecommons\.org/licenses/by-nc/"),
    ("cc-by-nc-4.0", "creative commons", r"Creative\s+Commons\s+Attribution-Non-?Commercial", "CC-BY-NC-[1-4].0", r"creativecommons\.org/licenses/by-nc/"),
    ("cc-by-nd-4.0", "cc by nd", r"CC[ -]BY-ND(?:[ -][1-4]\.0)?", "CC-BY-ND-[1-4].0", r"creativecommons\.org/licenses/by-nd"),
    ("cc-by-nd-4.0", "creative commons", r"Creative\s+Commons\s+Attribution-No-?Deriv\w*", "CC-BY-ND-[1-4].0", r"creativecommons\.org/licenses/by-nd"),
    ("cc-by-sa-4.0", "cc by sa", r"CC[ -]BY-SA(?:[ -][1-4]\.0)?", "CC-BY-SA-[1-4].0", r"creativecommons\.org/licenses/by-sa"),
    ("cc-by-sa-4.0", "creative commons", r"Creative\s+Commons\s+Attribution-Share-?Alike", "CC-BY-SA-[1-4].0", r"creativecommons\.org/licenses/by-sa"),
    ("cc-by-4.0", "cc by", r"CC[ -]BY(?:[ -][1-4]\.0)?", "CC-BY-[1-4].0", r"creativecommons\.org/licenses/by/"),
    ("cc-by-4.0", "creative commons", r"Creative\s+Commons\s+Attribution", "CC-BY-[1-4].0", r"creativecommons\.org/licenses/by/"),
    ("sspl-1.0", "server side public", r"Server\s+Side\s+Public\s+licen[cs]e", "SSPL-1.0", r"mongodb\.com/licensing/server-side"),
    ("elastic-2.0", "elastic", r"Elastic\s+licen[cs]e", "Elastic-2.0", r"elastic\.co/licensing/elastic-license"),
    ("ssh-short", "ssh licen", r"SSH\s+licen[cs]e", "SSH-short", r"openssh\.com/.{0,20}LICEN[CS]E"),
    ("upl-1.0", "universal permissive", r"Universal\s+Permissive\s+licen[cs]e", "UPL-1.0", r"opensource\.org/licenses?/upl"),
    ("vim", "vim licen", r"Vim\s+licen[cs]e", "Vim", r"vimhelp\.org/uganda"),
    ("w3c", "w3c", r"W3C\s+(?:Software\s+)?(?:Notice\s+and\s+)?licen[cs]e", "W3C", r"w3\.org/Consortium/Legal"),
    ("zpl-2.1", "zope", r"Zope\s+Public\s+licen[cs]e", "ZPL-[12].[01]", r"zope\.org/Resources/ZPL"),
]
# Label, keyword, sentence of the license's text.
TEXTS = [
    ("mit", "permission is hereby granted", r"Permission\s+is\s+hereby\s+granted,\s+free\s+of\s+charge,\s+to\s+any\s+person\s+obtaining\s+a\s+copy\s+of\s+this\s+software\s+and\s+associated"),
    ("bsl-1.0", "permission is hereby granted", r"Permission\s+is\s+hereby\s+granted,\s+free\s+of\s+charge,\s+to\s+any\s+person\s+or\s+organization\s+obtaining\s+a\s+copy"),
    ("isc", "permission to use", r"Permission\s+to\s+use,\s+copy,\s+modify,\s+and(?:/or)?\s+distribute\s+this\s+software\s+for\s+any\s+purpose\s+with\s+or\s+without\s+fee"),
    ("bsd", "redistribution and use", r"Redistribution\s+and\s+use\s+in\s+source\s+and\s+binary\s+forms,\s+with\s+or\s+without\s+modification,?\s+are\s+permitted"),
    ("unlicense", "unencumbered", r"free\s+and\s+unencumbered\s+software\s+released\s+into\s+the\s+public\s+domain"),
    ("zlib", "express or implied warranty", r"provided\s+.as-is.,\s+without\s+any\s+express\s+or\s+implied\s+warranty"),
    ("gpl", "is free software", r"This\s+(?:program|library)\s+is\s+free\s+software[;:]\s+you\s+can\s+redistribute\s+it\s+and/or\s+modify"),
    ("gpl", "verbatim copies", r"Everyone\s+is\s+permitted\s+to\s+copy\s+and\s+distribute\s+verbatim\s+copies\s+of\s+this\s+licen[cs]e\s+document"),
    ("mpl-2.0", "source code form", r"This\s+Source\s+Code\s+Form\s+is\s+subject\s+to\s+the\s+terms\s+of\s+the\s+Mozilla\s+Public\s+licen[cs]e"),
    ("apache-2.0", "terms and conditions for use", r"terms\s+and\s+conditions\s+for\s+use,\s+reproduction,\s+and\s+distribution"),
    ("cc0-1.0", "dedicated the work", r"has\s+dedicated\s+the\s+work\s+to\s+the\s+public\s+domain"),
]
#: Rules that name no license: they count only where nothing else is left.
NOTICES = [
    ("copyright-notice", "copyright", r"copyright\s+(?:\(c\)|©)?\s*\d{4}"),
    ("all-rights-reserved", "all rights reserved", r"all\s+rights\s+reserved"),
    ("public-domain", "public domain", r"(?:released\s+into|placed\s+in|in)\s+the\s+public\s+domain"),
    ("proprietary", "proprietary", r"proprietary\s+(?:and\s+confidential|licen[cs]e|software)"),
    ("other-license", "licen", r"licen[cs]ed\s+(?:under|to)\b"),
]
#: Templates, best first: priority, weight, pattern around a license's own.
TAG, GRANT, ADDRESS, NAME, NOTICE = range(1, 6)
WEIGHTS = {TAG: 1.0, GRANT: 0.95, ADDRESS: 0.9, NAME: 0.7, NOTICE: 0.5}
GRANTED = r"(?:licen[cs]ed|released|distributed|available|provided|published|covered)\s+(?:under|by)\s+(?:an?\s+|the\s+)?(?:terms\s+(?:and\s+conditions\s+)?of\s+)?(?:an?\s+|the\s+)?"
# Phrases of words and their labels.
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]
#: Every rule and phrase needs one of these in the lower-case text.
GATE = ["licen", "spdx", "copyright", "reserved", "domain", "proprietary", "creative", "attribution", "cc0", "cc by", "cc-by", "wtfpl", "bsd", ".org", ".net", ".com/", ".eu", "permission", "redistribut", "unencumbered", "warranty", "reproduction", "source code"]
WORD, GAP = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
HIT = "struct<start:int,back:int,pri:int,id:int,label:string>"


def rules() -> list[dict]:
    """All signature rules, in order: one for each license and template, sentences, then the notices."""
    made, tags = [], set()
    for label, keyword, name, spdx, address in LICENSES:
        own = [(GRANT, keyword, GRANTED + rf"(?:{name})"), (ADDRESS, address.split(r"\.")[0].rsplit("/", 1)[-1], rf"(?:https?://)?(?:www\.)?{address}"), (NAME, keyword, rf"(?<![\w-])(?:{name})(?![\w-])")]
        if spdx not in tags:
            tags.add(spdx)
            own.insert(0, (TAG, "spdx-license", rf"SPDX-License-Identifier:[\s(]*(?:[\w.+-]+[\s)]+(?:AND|OR|WITH)[\s(]+)*{spdx}(?![\w.-])"))
        made += [(*r, label) for r in own]
    made += [(GRANT, keyword, pattern, label) for label, keyword, pattern in TEXTS]
    made += [(NOTICE, keyword, pattern, label) for label, keyword, pattern in NOTICES]
    return [{"id": i, "pri": p, "kw": k.lower().replace("-", " "), "re": f"(?i){x}", "label": label} for i, (p, k, x, label) in enumerate(made)]


def rule_array() -> str:
    """SQL: all rules, a literal of the plan. As a column it would be copied into every row."""
    return "array(" + ", ".join(f"named_struct('id', {r['id']}, 'pri', {r['pri']}, 'kw', r'{r['kw']}', 're', r'{r['re']}', 'label', r'{r['label']}')" for r in rules()) + ")"


def hits(text: str, low: str) -> str:
    """SQL: the sorted intervals of all rules whose keyword occurs. back is minus the end."""
    # the text is bound to a variable: the optimizer would work out a column again for every rule
    found = f"flatten(transform(array({low}), low -> filter(transform(filter({rule_array()}, r -> contains(low, r.kw)), r -> struct(r, regexp_extract_all({text}, r.re, 0) AS ms)), f -> size(f.ms) > 0)))"
    one = f"""transform({found}, f -> aggregate(
        zip_with(f.ms, split({text}, f.r.re), (m, before) -> struct(m, before)),
        struct(0 AS at, cast(array() AS array<{HIT}>) AS found),
        (a, x) -> IF(x.m IS NULL, a, struct(a.at + char_length(x.before) + char_length(x.m) AS at, concat(a.found, array(named_struct('start', a.at + char_length(x.before), 'back', -(a.at + char_length(x.before) + char_length(x.m)), 'pri', f.r.pri, 'id', f.r.id, 'label', f.r.label))) AS found)),
        a -> a.found))"""
    return f"array_sort(flatten({one}))"


def kept(found: str) -> str:
    """SQL: hits within no other of their priority or a better one. Sorted so, whatever holds a
    hit comes before it, and the furthest end so far for each priority decides. A tag's own hits
    begin alike, one for each license in it, and all stay."""
    ends = ", ".join(f"-1 AS e{p}" for p in WEIGHTS)
    furthest = "greatest(" + ", ".join(f"IF({p} <= d.pri, a.e{p}, -1)" for p in WEIGHTS) + ")"
    moved = ", ".join(f"IF(d.pri = {p}, greatest(a.e{p}, -d.back), a.e{p}) AS e{p}" for p in WEIGHTS)
    return f"""aggregate({found}, struct(cast(array() AS array<{HIT}>) AS found, {ends}),
        (a, d) -> struct(IF(d.pri > {TAG} AND {furthest} >= -d.back, a.found, concat(a.found, array(d))) AS found, {moved}), a -> a.found)"""


def words(text: Column) -> Column:
    """The number of words: pieces between gaps, but for empty ones at either end."""
    first = (text == "") | F.substring(text, 1, 1).rlike(GAP)
    last = (text != "") & F.substring(text, -1, 1).rlike(GAP)
    return F.size(F.split(text, f"{GAP}+")).cast("long") - first.cast("long") - last.cast("long")


def phrase_pattern() -> str:
    any_of = "|".join(f"{GAP}+".join(p.split()) for p, _ in PHRASES)
    return f"(?i)(?<!{WORD})(?:{any_of})(?!{WORD})"


def scan(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """docs with n_words, n_base, first_word, last_word, base_labels, labels, score and hits."""
    new = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "hits"]
    keep = [F.col(f"`{c}`") for c in docs.columns if c not in new]
    pattern = phrase_pattern()
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.select(*keep, text.alias("__text"), F.lower(text).alias("__lower"))
    df = df.withColumn("__gate", functools.reduce(lambda a, b: a | b, [F.contains("__lower", F.lit(k)) for k in GATE]))
    df = df.withColumns({
        "n_words": words(F.col("__text")),
        "__places": F.when(F.col("__gate"), F.regexp_extract_all("__text", F.lit(pattern), 0)).otherwise(F.array().cast("array<string>")),
        "__low": F.when(F.col("__gate"), F.regexp_replace("__lower", r"[\s-]+", " ")).otherwise(F.lit("")),
    })
    df = df.withColumn("__hits", F.expr(f"IF(__gate, {hits('__text', '__low')}, cast(array() AS array<{HIT}>))"))
    df = df.withColumn("__kept", F.expr(kept("__hits")))
    df = df.withColumn("__kept", F.expr(f"IF(exists(__kept, x -> x.pri < {NOTICE}), filter(__kept, x -> x.pri < {NOTICE}), __kept)"))
    any_place = F.size("__places") > 0
    pieces = F.split("__text", pattern)
    last = F.lower(F.regexp_replace(F.element_at("__places", -1), f"{GAP}+", " "))
    named = F.transform("__places", lambda p: F.lower(F.regexp_replace(p, f"{GAP}+", " ")))
    label_of = F.create_map(*(F.lit(x) for pair in PHRASES for x in pair))
    base = F.array_sort(F.array_distinct(F.transform(named, lambda p: F.element_at(label_of, p))))
    weight_of = F.create_map(*(F.lit(x) for pair in WEIGHTS.items() for x in pair))
    df = df.withColumn("__base", F.when(any_place, base).otherwise(F.array().cast("array<string>")))
    own = F.transform("__kept", lambda x: x["label"])
    return df.select(
        *keep, "n_words", F.size("__places").cast("long").alias("n_base"),
        F.when(any_place, words(pieces[0])).alias("first_word"),
        F.when(any_place, F.col("n_words") - words(F.element_at(pieces, -1)) - words(last)).alias("last_word"),
        F.array_join("__base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(own, "__base"))), ",").alias("labels"),
        F.greatest(F.when(any_place, F.lit(0.5)).otherwise(F.lit(0.0)), F.coalesce(F.array_max(F.transform("__kept", lambda x: F.element_at(weight_of, x["pri"]))), F.lit(0.0))).alias("score"),
        F.transform("__kept", lambda x: F.struct(x["label"].alias("label"), x["start"].alias("start"), (-x["back"]).alias("end"))).alias("hits"),
    )


def op6_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text", "hits")


def license_scan_base(spark, sf_dir: str) -> DataFrame:
    """The base answers of op6_license_scan, which SQL can express."""
    return op6_license_scan(spark, sf_dir).drop("labels", "score")


BASE_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT doc_id, unnest(w) AS w, unnest(range(len(w))) AS spot FROM w),
n AS (SELECT doc_id, spot, w, lead(w) OVER o AS w1, lead(w, 2) OVER o AS w2 FROM i WINDOW o AS (PARTITION BY doc_id ORDER BY spot)),
p AS (SELECT doc_id, spot, CASE WHEN w = 'mit' AND w1 = 'license' THEN 'mit' WHEN w = 'apache' AND w1 = 'license' THEN 'apache' WHEN w = 'general' AND w1 = 'public' AND w2 = 'license' THEN 'gpl' END AS label FROM n)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels
FROM w LEFT JOIN (SELECT doc_id, count(*) AS n_base, min(spot) AS first_word, max(spot) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM p WHERE label IS NOT NULL GROUP BY doc_id) USING (doc_id)
"""
