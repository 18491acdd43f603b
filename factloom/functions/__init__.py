"""Column functions: text folding, tokens, URLs, typed normalizers, HTML blocks, robots rules."""
