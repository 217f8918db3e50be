"""martline.functions"""
