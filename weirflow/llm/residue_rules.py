"""Unfilled slots in the running text of one document. What is shown, quoted or discussed (code, quotes, block quotes) is no sign."""

from __future__ import annotations

import re

#: Names of template fields (fixed values); they count where a bracket style alone would be too common.
FIELDS = (
    "amount|component|contact|customer|date|description|email|env|error_?count|first_?name|full_?name|last_?name|link|name|number|owner|plan|region_?name|"
    "release_?date|service|start_?time|summary|team|tenant|ticket_?id|time|title|url|user(?:\\.?_?name)?|username|version|comp|hx|n"
)
_PHRASE = (
    r"(?:(?:insert|add|enter|describe|your|name of|link to|type|choose|replace|fill in)\b[^\[\]<>(){}*\n]{0,40}"
    r"|[^\[\]<>(){}*\n]{0,40}\bhere|owner['’]?s name|version number|date|team name)"
)
_IDENT = r"[A-Za-z_][\w.]*"

#: A slot of a template, or a bare stand-in for a missing value.
SLOT = re.compile(
    # every alternative begins with one of these characters
    r"(?=[{$<%_*«X?\[&(#@u])(?:" + "|".join(
        [
            r"\{\{\{?\s*[#/^&>]?\s*\.?[\w.' ]{0,40}\}?\}\}",
            r"(?<![=\w\"'])\$\{\s*[\w.]{0,40}\s*\}(?!/)",
            r"(?<![=\w\"'])\$\(\s*" + _IDENT + r"\s*\)(?!/)",
            r"<%[=-]?\s*[\w.' ]{0,40}\s*-?%>",
            r"<no value>|\[object Object\]|%!\w\((?:MISSING|NOVERB|BADINDEX|BADPREC|BADWIDTH|EXTRA[^)]*|PANIC=[^)]*)\)",
            r"%\(" + _IDENT + r"\)[sd]",
            r"(?<![\w%])%" + _IDENT + r"%(?![\w%])",
            r"(?<![\w%\"'(=])%[svd](?![\w%])",
            r"(?<![\w.])__[A-Za-z]\w*?__(?![\w(])",
            r"(?<![\w])_{5,}(?!\w)",
            r"\*{3,}\s*(?i:" + _PHRASE + r")\s*\*{3,}",
            r"«(?i:" + FIELDS + r")»",
            r"(?<!\w)X{4,}(?!\w)",
            r"(?<![\w?!])\?{3}(?![\w?!])",
            r"(?<![\w\])])\[\[?\s*(?i:" + _PHRASE + r")\s*\]?\](?!\()",
            r"(?<!\w)\[\[\s*(?i:" + FIELDS + r")\s*\]\]",
            r"<(?i:" + _PHRASE + r")>",
            r"&lt;\s*(?i:" + _PHRASE + "|" + FIELDS + r")\s*&gt;",
            r"\((?i:[a-z][\w' ]{0,40} here)\)",
            r"#\{" + _IDENT + r"\}",
            r"@@" + _IDENT + r"@@",
            r"(?<![/\w$#{%(\"'.=])\{(?i:" + FIELDS + r")\}(?![/\w}])",
            r"(?<![\w.=<>!:\"'])undefined(?![\w.(:=\"'])",
        ]
    )
    + ")"
)
_HERE = r"[^\[\]<>(){}*\n]{0,40}\b(?i:here)\b"
#: Cheap test that refuses only texts without a slot; ``undefined`` is looked for by itself. A pattern that begins with a set of
#: characters passes over all others fast.
_MAY = re.compile(
    r"[{$#<%«\[_*X?&@(](?:(?<=\{)\{|(?<=[$#])\{|(?<=\$)\(|(?<=<)%|(?<=\{)(?i:" + FIELDS + r")\}|(?<=%)[!(A-Za-z_]|(?<=«)|(?<=\[)(?:\[|\s*[^\W\d_]|" + _HERE + r")|(?<=_)_|(?<=\*)\*\*"
    r"|(?<=X)XXX|(?<=\?)\?\?|(?<=<)(?:[^\W\d_]|" + _HERE + r")|(?<=&)lt;|(?<=@)@|(?<=\()[A-Za-z][^()\n]{0,44}(?i:here)\))"
)
_FENCE = re.compile(r"^[ \t]*(```|~~~).*?(?:^[ \t]*\1[^\n]*$|\Z)", re.M | re.S)
_SHOWN = re.compile(r"`[^`\n]*`|\"[^\"\n]{0,300}\"|“[^”\n]{0,300}”|^[ \t]*>[^\n]*", re.M)
_DISCUSSED = re.compile(r"(?i)\b(?:such as|leftovers?|placeholders?|templates?|linter|renderer|is undefined (?:in|for|by|when|behaviou?r)|undefined behaviou?r)\b")
_CODE_LINE = re.compile(r"^\s*(?:func|package|import|return|if|for|var|const|type|def|class|let|use|log\.|fmt\.|//|/\*|\*/|\}|export |echo )|[{};]\s*$|:=")


#: Characters of a line that are looked at on either side of a slot.
CONTEXT = 500


def has_slot(text: str) -> bool:
    """Whether running text holds a slot that was left unfilled. The whole text is searched."""
    if "undefined" not in text and not _MAY.search(text):
        return False
    if "```" in text or "~~~" in text:
        text = _FENCE.sub(" ", text)
    text = _SHOWN.sub('""', text)
    for m in SLOT.finditer(text):
        # its line, of a very long one the part around it
        low, high = max(0, m.start() - CONTEXT), min(len(text), m.end() + CONTEXT)
        a, b = text.rfind("\n", low, m.start()), text.find("\n", m.end(), high)
        a = a + 1 if a >= 0 else low
        line = text[a : b if b >= 0 else high]
        if _CODE_LINE.search(line) and not m[0].startswith(("{{", "<no", "%!", "<%", "__", "[object")):
            continue
        # the sentence around the slot
        at = m.start() - a
        begin = max(line.rfind(". ", 0, at), line.rfind("! ", 0, at), line.rfind("; ", 0, at)) + 1
        ends = [e for e in (line.find(". ", at), line.find("! ", at)) if e >= 0]
        if _DISCUSSED.search(line[begin : min(ends, default=len(line))]):
            continue
        return True
    return False
