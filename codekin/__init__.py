"""codekin: document and source-code similarity analytics as Spark plans."""
