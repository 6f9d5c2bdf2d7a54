"""Writers: JSON, SARIF, Navigator layers, rule scaffolds, text, and gates."""
