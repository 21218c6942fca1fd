"""quarrymill.functions"""
