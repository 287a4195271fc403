"""Which tags make up which searchable, sortable and shown fields."""

from __future__ import annotations

# Phrase codes and their tags.
PHRASE_TAGS = {
    "AN": ("AN",), "CY": ("CY",), "DS": ("DS",), "IN": ("IN",), "SF": ("SF",), "ST": ("ST",), "AS": ("AS",),
    "B1": ("BT",), "A1": ("AT",), "D1": ("DT",), "FY": ("FY",), "GC": ("PA", "JC"), "GY": ("GY",), "IC": ("IC",),
    "OC": ("OC",), "PC": ("RP", "AC", "CM", "FS", "CT"), "PD": ("PD",), "PN": ("PN",), "PP": ("PX",), "PS": ("PS",),
    "PT": ("PT",), "RE": ("RE",), "SC": ("SC",), "SD": ("SD",), "SH": ("PH", "GH"), "TD": ("TD",), "UP": ("UP",),
    "ZP": ("ZP",), "PO": ("PF", "PI"),
}
# Word codes and their tags, the alias, and the codes of the merged index.
WORD_TAGS = {"/TI": ("TI",), "/OB": ("OB",), "/AP": ("AP",), "/DE": ("DE",), "/PR": ("PR",), "/PB": ("PB",), "/TX": ("AP", "OB", "PR"), "PO=": ("PF", "PI")}
WORD_ALIASES = {"/DF": "/DE"}
MERGED = ("/TX", "/TI", "/DE", "/PB")
# Display codes whose tag has another name or that have several tags; any other code shows the tag of its name.
DISPLAY_TAGS = {"NR": ("NA",), "TX": ("AP", "OB", "PR"), "A1": ("AT",), "B1": ("BT",), "D1": ("DT",), "GC": ("PA", "JC"), "PC": ("RP", "AC", "CM", "FS", "CT"), "PO": ("PF", "PI"), "PP": ("PX",), "SC": ("SC", "SN"), "SH": ("PH", "GH"), "SD": ("SX",), "TD": ("TX",)}
DISPLAY_CODES = (
    "AP", "DE", "NR", "OB", "PB", "PR", "TI", "TX", "A1", "AN", "AS", "B1", "CY", "D1", "DS", "FY", "GC", "IC", "IN", "OC", "PC", "PD", "PN", "PO", "PP",
    "PS", "PT", "RE", "RG", "RN", "SC", "SF", "SH", "ST", "UP", "ZP", "CG", "SD", "TD", "AG", "AI", "CD", "GD", "GY", "ID", "N1", "NC", "SP", "UL", "XP",
)
# Fields that a set can be sorted by, and tags that hold one value.
SORTABLE = (
    "AG", "AI", "AN", "AS", "AT", "CG", "CY", "DS", "ID", "IN", "PD", "PN", "PO", "PT", "RE", "SF", "SP", "ST", "ZP",
)
SINGLE_TAGS = (
    "AN", "PN", "TI", "PS", "PT", "AS", "DS", "IC", "PI", "CY", "ST", "ZP", "RE", "CG", "RG", "RN", "OC", "PD", "SD", "SX", "TD", "TX", "FY", "GY", "UP",
    "PP", "PX", "BT", "AT", "DT", "OB", "AP", "DE", "PR", "PB",
)


def display_tags(code: str) -> tuple[str, ...]:
    if code not in DISPLAY_CODES:
        raise ValueError(f"unknown display code: {code}")
    return DISPLAY_TAGS.get(code, (code,))
