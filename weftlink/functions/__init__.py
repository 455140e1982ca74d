"""Part of weftlink."""
