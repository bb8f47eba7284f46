"""Record linkage and text analytics as DataFrame plans."""
