"""Part of panelyard; see the package docstring."""
