"""Text escapes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that XML text and attributes escape, the ampersand first.
XML = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"))


def xml_escape(c: Column) -> Column:
    for plain, name in XML:
        c = F.replace(c, F.lit(plain), F.lit(name))
    return c


def xml(text: str) -> str:
    """As xml_escape(), for texts of the driver."""
    for plain, name in XML:
        text = text.replace(plain, name)
    return text
