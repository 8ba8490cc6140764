"""Part of fernwork; see the README for the layout."""
