"""From text to plan: lexer, parser, syntax tree, name scopes and the binder that emits lazy DataFrames."""
