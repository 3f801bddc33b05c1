"""Part of vintagepanel; see the package docstring."""
