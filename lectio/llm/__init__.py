"""Training-data operators over whole tables: one module per operator, ``queries`` registers
them. Nothing outside this subpackage imports it."""
