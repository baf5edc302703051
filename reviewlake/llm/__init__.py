"""Training-data operators: mixing, decontamination, secrets, tokens, media,
HTML, near duplicates, quality, web archives and language.  Nothing outside
this subpackage imports it."""
