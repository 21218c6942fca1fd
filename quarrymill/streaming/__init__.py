"""quarrymill.streaming"""
