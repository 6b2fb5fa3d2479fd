"""How plans are cut and which queries there are."""
