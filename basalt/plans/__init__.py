"""Query shapes built from functions and operators."""
