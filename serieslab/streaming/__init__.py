"""No operator of this engine is a streaming one: all work on tables whose rows have their final order."""
