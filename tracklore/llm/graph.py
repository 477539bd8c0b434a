"""Connected components of links, as the rest of the library has them."""

from ..operators.links import components as components
