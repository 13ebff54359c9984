"""Whole-archive processing: bands to masks, score maps and colour views."""
