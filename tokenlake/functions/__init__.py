"""Pattern algebra: byte sets, patterns over bytes, and code points spelled in UTF-8."""

from .charset import Charset
from .pattern import Pattern, any_of, at_least, choice, concat, decimal_float, decimal_integer, exact, identifier, kleene, optional, plus, repeat, text

__all__ = ["Charset", "Pattern", "any_of", "at_least", "choice", "concat", "decimal_float", "decimal_integer", "exact", "identifier", "kleene", "optional", "plus", "repeat", "text"]
