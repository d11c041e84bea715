"""The dialect's front end: text to tokens, syntax tree, bound tree, plan, and DataFrame."""
