"""Fixed values of the specification as the SQL side states them: spelled out here, not taken from the engine, so that a slip in one shows."""

# White space, a token, marks dropped from texts.
SPACES = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0                　"
TOKEN = r"\p{N}+(?:[.,]\p{N}+)?|\p{L}[\p{L}\p{M}]*(?:[-’'][\p{L}\p{M}]+)*"
ZERO_WIDTH = "​‌‍﻿"
# Words without a topic, units of money, words a topic word brings along.
STOPWORDS = (
    "what was were the is are as of in on for to and a an at by from with who which how much many did do does this that these those "
    "year date march 31 2025 2024 fy between happened company companies reported report say said"
).split()
UNITS = "lakh lakhs crore crores million billion".split()
EXPANSIONS = {"types": ["kind", "category", "classification"], "type": ["kind", "category", "classification"], "difference": ["different", "comparison"], "differences": ["different", "comparison"]}
# What tells Marathi from Hindi.
MARATHI_HINTS = "आहे आणि मध्ये म्हणून करण्यासाठी यांच्या तसेच होते असलेले महाराष्ट्र आपण त्यामुळे यामुळे करण्यात झालेले असून यांना".split()
HINDI_HINTS = "है और में के की का था थी थे होता होती यह से लिए तथा लेकिन द्वारा करने किया गया गई".split()
MARATHI_LETTERS = "ळऴॲऑ"
# Cells of a table's head; names looked for in answers; phrases that weigh in reranking.
TABLE_LABELS = ["particulars", "standalone", "consolidated", "fy 2024-25", "fy 2023-24", "march 31, 2025", "march 31, 2024", "march 31 2025", "march 31 2024"]
KNOWN_NAMES = ["cash and cash equivalents", "bank balance other than cash and cash equivalents", "provision for standard assets", "total income", "total expenditure", "total exposure to the top five npa accounts"]
PHRASES = {
    "joint venture": 8.0, "joint ventures": 8.0, "venture partners": 8.0, "cash and cash equivalents": 8.0, "bank balance other than cash and cash equivalents": 12.0,
    "bank deposits": 6.0, "provision for standard assets": 12.0, "total exposure to top five npa accounts": 12.0, "total income": 10.0, "total expenditure": 10.0,
}
# What asks for arithmetic, and for a comparison.
ARITHMETIC = [
    r"\b(calculate|compute|solve|evaluate)\b",
    r"\b\p{Nd}+(?:\.\p{Nd}+)?\s*(?:%|percent)\b",
    r"\p{Nd}+(?:\.\p{Nd}+)?\s*[+\-*/^]\s*\p{Nd}+(?:\.\p{Nd}+)?",
    r"\b(?:add|subtract|multiply|divide)\b.*\p{Nd}",
    r"\bdifference between\b.*\p{Nd}.*\p{Nd}",
]
COMPARATIVE = "between change changed increase decrease growth difference compared comparison".split()
