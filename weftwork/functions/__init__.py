"""Column functions: lexical primitives that every operator builds on."""
