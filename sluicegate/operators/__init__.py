"""Record trees, XPath, record grammars and the row interpreter."""
