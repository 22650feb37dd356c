"""Double Metaphone codes (L. Philips, C/C++ Users Journal, June 2000) as a rule table.

Each rule is a pattern tried at the current letter; look-around gives the context, and what
the pattern consumes is replaced by the two codes. The first rule that matches applies.
"""

from __future__ import annotations

import re

# Pattern, primary code, secondary code (None = same), condition on the word.
# Conditions: S slavo-germanic, n not slavo-germanic, G germanic, g not germanic.
RULES: dict[str, list[tuple]] = {
    "B": [("BB?", "P", None)],
    "Ç": [("Ç", "S", None)],
    "C": [
        (r"(?<=[^AEIOUY]A)CH(?=ER)(?<=[BM]ACH)", "K", None), (r"(?<=[^AEIOUY]A)CH(?![IE])", "K", None),
        (r"^CAESAR", "SSR", None), (r"CH(?=IA)", "K", None), (r"(?<!^)CH(?=AE)", "K", "X"),
        (r"^CH(?!ORE)(?=ARAC|ARIS|OR|YM|IA|EM)", "K", None), (r"CH", "K", None, "G"),
        (r"(?<=OR)CH(?=ES|ID)|(?<=AR)CH(?=IT)", "K", None), (r"CH(?=[TS])", "K", None),
        (r"(?:(?<=[AOUE])|^)CH(?=[LRNMBHFVW ])", "K", None), (r"(?<=^M)CH|(?<=^MC)H", "K", None),
        (r"^CH", "X", None), (r"CH", "X", "K"), (r"(?<!WI)CZ", "S", "X"), (r"CCIA", "X", None),
        (r"(?:(?<=^A)|(?<=U))CC(?=EE|ES)", "KS", None), (r"(?<=^A)CC(?=[IEH])(?!CCHU)", "KS", None),
        (r"(?<!^M)CC(?=[IE]|H(?!U))[IEH]", "X", None), (r"(?<!^M)CC", "K", None),
        (r"C[KGQ]", "K", None), (r"C(?:I(?=[OEA]))", "S", "X"), (r"C[IEY]", "S", None),
        (r"C [CQG]", "K", None), (r"C[CKQ](?!(?<=C)[EI])", "K", None), (r"C", "K", None),
    ],
    "D": [(r"DG[IEY]", "J", None), (r"DG", "TK", None), (r"D[TD]?", "T", None)],
    "F": [("FF?", "F", None)],
    "G": [
        (r"(?<=[^AEIOUY])GH", "K", None), (r"^GH(?=I)", "J", None), (r"^GH", "K", None),
        (r"(?<=[BHD].)GH|(?<=[BHD]..)GH|(?<=[BH]...)GH", "", None), (r"(?<=[CGLRT].U)GH", "F", None),
        (r"(?<=[^I])GH", "K", None), (r"GH", "", None),
        (r"(?<=^[AEIOUY])GN", "KN", "N", "n"), (r"GN(?!EY)", "N", "KN", "n"), (r"GN", "KN", None),
        (r"G(?=LI)L", "KL", "L", "n"), (r"^G(?=Y|E[SPBLYIR]|I[BLNE])[YEI]", "K", "J"),
        (r"(?<![EIRO])G(?:E(?=R)|Y)(?<!^DANGE)(?<!^RANGE)(?<!^MANGE)", "K", "J"),
        (r"G[EIY]", "K", None, "G"), (r"GE(?=T)", "K", None), (r"GI(?=ER(?: |$))", "J", None),
        (r"G[EIY]|(?<=[AO])GG(?=I)", "J", "K"), (r"GG?", "K", None),
    ],
    "H": [(r"(?:^|(?<=[AEIOUY]))H[AEIOUY]", "H", None), ("H", "", None)],
    "J": [
        (r"^J(?=OSE(?: |$))", "H", None), (r"J(?=OSE)", "J", "H"), (r"^JJ?", "J", "A"),
        (r"(?<=[AEIOUY])J(?=[AO])", "J", "H", "n"), (r"J$", "J", ""),
        (r"(?<![SKL])J(?![LTKSNMBZ])J?", "J", None), (r"JJ?", "", None),
    ],
    "K": [("KK?", "K", None)],
    "L": [(r"(?<=I)LL(?=[OA]$)|(?<=A)LL(?=E$)", "L", ""), (r"(?<=A)LL(?=E.*(?:AS|OS|A|O)$)", "L", ""), ("LL?", "L", None)],
    "M": [(r"(?<=U)MB(?=$|ER)", "M", None), ("MM?", "M", None)],
    "N": [("NN?", "N", None)],
    "Ñ": [("Ñ", "N", None)],
    "P": [("PH", "F", None), ("P[PB]?", "P", None)],
    "Q": [("QQ?", "K", None)],
    "R": [(r"(?<!ME)(?<!MA)(?<=IE)R$(?<!MEIER)(?<!MAIER)", "", "R", "n"), ("RR?", "R", None)],
    "S": [
        (r"(?<=[IY])S(?=L)", "", None), (r"^S(?=UGAR)", "X", "S"), (r"SH(?=EIM|OEK|OLM|OLZ)", "S", None),
        ("SH", "X", None), (r"SI[OA]", "S", None, "S"), (r"SI[OA]", "S", "X"), (r"^S(?=[MNLW])|SZ", "S", "X"),
        (r"SCH(?=ER|EN)", "X", "SK"), (r"SCH(?=OO|UY|ED|EM)", "SK", None), (r"^SCH(?![AEIOUYW])", "X", "S"),
        ("SCH", "X", None), (r"SC[IEY]", "S", None), ("SC.?", "SK", None), (r"(?<=[AO]I)S$", "", "S"), (r"S[SZ]?", "S", None),
    ],
    "T": [
        (r"TIO(?=N)|TIA|TCH", "X", None), (r"T(?:H|TH)(?=[OA]M)", "T", None), (r"TT?H", "T", None, "G"),
        (r"TTH|TH", "0", "T"), (r"T[TD]?", "T", None),
    ],
    "V": [("VV?", "F", None)],
    "W": [
        (r"WR", "R", None), (r"^W(?=[AEIOUY])", "A", "F"), (r"^W(?=H)", "A", None), (r"(?<=[AEIOUY])W$", "", "F"),
        (r"(?<=[EO])W(?=SK[IY])", "", "F"), (r"W(?=.*)(?<=^SCHW)", "", "F"), (r"WI[CT]Z", "TS", "FX"), ("W", "", None),
    ],
    "X": [(r"^X", "S", None), (r"(?<=[IE]AU)X$|(?<=[AO]U)X$", "", None), (r"X[CX]?", "KS", None)],
    "Z": [("ZH", "J", None), (r"Z(?=[OIA])", "S", "TS"), (r"(?<!^)(?<!T)ZZ?", "S", "TS", "S"), ("ZZ?", "S", None)],
}
COMPILED = {
    letter: [(re.compile(rule[0]), rule[1], rule[1] if rule[2] is None else rule[2], rule[3] if len(rule) > 3 else "") for rule in rules]
    for letter, rules in RULES.items()
}
SILENT_START = re.compile("GN|KN|PN|WR|PS")
SLAVO = re.compile("W|K|CZ|WITZ")
GERMANIC = re.compile("VAN |VON |SCH")


def double_metaphone(word: str) -> tuple[str, str]:
    """Primary and secondary code; the secondary is empty when it equals the primary."""
    name = word.strip().upper()
    holds = {"": True, "S": bool(SLAVO.search(name)), "G": bool(GERMANIC.match(name))}
    holds |= {"n": not holds["S"], "g": not holds["G"]}
    primary, secondary = [], []
    at = 1 if SILENT_START.match(name) else 0
    while at < len(name):
        char = name[at]
        if char in "AEIOUY":
            if at == 0:
                primary.append("A")
                secondary.append("A")
            at += 1
            continue
        step = 1
        for pattern, first, second, condition in COMPILED.get(char, ()):
            hit = pattern.match(name, at) if holds[condition] else None
            if hit:
                primary.append(first)
                secondary.append(second)
                step = max(1, hit.end() - at)
                break
        at += step
    first, second = "".join(primary), "".join(secondary)
    return first, "" if first == second else second
